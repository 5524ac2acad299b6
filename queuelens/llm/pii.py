"""Personal data with offset-preserving deobfuscation.

Plain spans are found in the text as it is, by the patterns of `BASE`. For
disguised ones a chain of transducers rewrites the text, each of them mapping
every character it writes to the source characters it stands for:

1. homoglyphs and full-width forms become the ASCII characters they imitate,
   invisible characters vanish;
2. spelled digits ("five", "cinq", "null") become digits in runs, also of
   words and figures, that stand for `SPELLED_RUN` digits or have three dots;
   "double" and "triple" repeat, spelled dots between digits become ".", and
   the digits between two dots are written together;
3. "at" and "dot" in brackets, or spelled between the parts of an address,
   become "@" and ".".

Identifiers are detected in what the transducers write, and their spans are
mapped back to source characters. A span so found is added unless it overlaps
a plain span or one added before it of any kind. Texts without any trigger
are not rewritten, so clean documents cost one scan.

Results, also for odd input:

* a null text counts as empty, and empty texts have no spans;
* offsets count code points, ends are exclusive, texts are searched whole;
* failing matches (Luhn, octets, number of digits) are dropped, not retried;
* repeated rows get equal results, an empty table gives no rows;
* all columns pass through, except those named like an output.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.llm.common import append_columns, texts
from queuelens.llm.textstats import buffers, hashes, member
from queuelens.llm.textstats import spans as spans_of

KINDS = ("email", "ip", "card", "phone")
_NO_DIGIT = re.compile("[^0-9]+")
#: The patterns of plain identifiers.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PATTERNS = {k: re.compile(v) for k, v in BASE.items()}
# The same matches in linear time: the first part ends at a dot, so that a run of digits is tried once, from its start.
PATTERNS["ip"] = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
#: The digits of the shortest identifier without dots; a run of spelled digits and figures stands for as many.
SPELLED_RUN = 9
#: Digits spelled in the four languages of the corpus.
DIGIT_WORDS = {
    "0": "zero oh zéro null cero",
    "1": "one un eins uno",
    "2": "two deux zwei zwo dos",
    "3": "three trois drei tres",
    "4": "four quatre vier cuatro",
    "5": "five cinq fünf cinco",
    "6": "six sechs seis",
    "7": "seven sept sieben siete",
    "8": "eight huit acht ocho",
    "9": "nine neuf neun nueve",
}
#: Letters of other scripts that look like ASCII letters.
LOOK_ALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ı": "i", "ɑ": "a", "ɡ": "g",
    "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"


def _glyphs() -> dict[str, str]:
    """Look-alikes, invisible characters, and whatever is compatible with one ASCII character."""
    table = dict(LOOK_ALIKES) | dict.fromkeys(INVISIBLE, "")
    compatible = [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x24EA), *range(0x0660, 0x066A), *range(0x06F0, 0x06FA), *range(0x0966, 0x0970)]
    for code in compatible:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        digit = unicodedata.decimal(c, None)
        plain = str(digit) if digit is not None else plain
        if len(plain) == 1 and plain.isascii():
            table[c] = plain
    return table


GLYPHS = _glyphs()
_PLAIN = str.maketrans(GLYPHS)
_VANISHING = np.array([ord(c) for c in INVISIBLE], np.uint32)
_VALUE = {w: d for d, words in DIGIT_WORDS.items() for w in words.split()}
_WORD = "|".join(sorted(_VALUE, key=len, reverse=True))
_UNIT = rf"(?:(?:double|triple)[ -]+)?(?:{_WORD}|[0-9]+)"
_SPELLED_DOT = r"(?:\s*[\[({<]\s*(?:dot|point|punkt|punto|\.)\s*[\])}>]\s*|[ ,.()-]+(?:dot|point|punkt|punto)[ ,.()-]+)"
_SPELLED = re.compile(rf"(?<!\w)(?:\+|plus[ -]+)?{_UNIT}(?:(?:{_SPELLED_DOT}|[ ,.()-]+){_UNIT})+(?!\w)", re.IGNORECASE)
_PARTS = re.compile(rf"(?P<many>double|triple)[ -]+(?={_WORD}|[0-9])|(?P<word>{_WORD})(?!\w)|(?P<figure>[0-9]+)|(?P<plus>plus[ -]+)", re.IGNORECASE)
_DOT_GAP = re.compile(rf"{_SPELLED_DOT}|\s*\.\s*", re.IGNORECASE)
_SPACES = re.compile(r"[ ,]+")
_DOT = r"(?:\s*[\[({<]\s*(?:dot|point|punkt|punto|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto)\s+|\.)"
_LABEL = r"[A-Za-z0-9-]+"
#: An "at" sign or its disguise, without the space around it.
_AT = re.compile(r"[\[({<]\s*(?:at|@|arroba|arobase|klammeraffe)\s*[\])}>]|(?<=\s)(?:at|arroba|arobase)(?=\s)|@", re.IGNORECASE)
_HOST = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+", re.IGNORECASE)
_BRACKET = re.compile(r"[\[({<]")
_DOTTED_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_DOT_TOKEN = re.compile(_DOT, re.IGNORECASE)

_ODD = re.compile("[" + re.escape("".join(GLYPHS)) + "]")
_MASK_TRIGGER = re.compile(r"[\[({<]\s*(?:at|@|arroba|arobase|klammeraffe|\.)\s*[\])}>]", re.IGNORECASE)
_DOT_WORDS = ("dot", "point", "punkt", "punto")
_BARE_DOTS = ("dot", "punkt", "punto")

Span = tuple[str, int, int]


def valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in found.split(".")))
    digits = _NO_DIGIT.sub("", found)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if not 12 <= len(digits) <= 19:
        return False
    digits = [int(c) for c in digits]
    twice = (d * 2 - 9 * (d > 4) for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Spans of the plain patterns: leftmost, non-overlapping within a kind."""
    out: list[Span] = []
    if "@" in text:
        out += _emails(text)
    for kind in ("ip", "card", "phone"):
        if kind != "phone" or "+" in text:
            out += [(kind, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if valid(kind, m[0])]
    return ordered(out)


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> list[Span]:
    """The matches of the plain email pattern, found from their @ signs.

    A match has one @, and begins with the whole run of local characters
    before it, as far as no earlier match took some of them.
    """
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Tape:
    """A text with, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str, begin: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.begin = np.arange(len(text), dtype=np.int32) if begin is None else begin
        self.end = np.arange(1, len(text) + 1, dtype=np.int32) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace the given stretches (in order, disjoint); each new character stands for its whole stretch."""
        if not edits:
            return self
        text, at = [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            at = b
        size = len(self.text)
        a, b = np.array([e[0] for e in edits]), np.array([e[1] for e in edits])
        inside = np.cumsum(np.bincount(a, minlength=size + 1) - np.bincount(b, minlength=size + 1))[:size]
        times = 1 - inside  # how often each character's place is written
        times[a] = [len(e[2]) for e in edits]
        end = self.end.copy()
        end[a] = self.end[b - 1]
        return Tape("".join([*text, self.text[at:]]), np.repeat(self.begin, times), np.repeat(end, times))

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.begin[a]), int(self.end[b - 1])


class Cover:
    """Which characters are taken."""

    def __init__(self, size: int):
        self.taken = bytearray(size)

    def add(self, a: int, b: int) -> None:
        self.taken[a:b] = b"\1" * (b - a)

    def meets(self, a: int, b: int) -> bool:
        return self.taken.find(1, a, b) >= 0


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def triggers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have a run of spelled digits, and which a spelled dot.

    Only such texts, and those with odd characters or an "at" in brackets,
    are rewritten. Array operations over all words of the texts, so that
    clean texts cost little.
    """
    data, offsets = buffers(column)
    start, end, text = spans_of(_IS_WORD[data], offsets)
    folded = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = hashes(folded, start, end)
    dotted = np.zeros(len(column), bool)
    dotted[text[member(word, _word_hashes(list(_DOT_WORDS)))]] = True
    digit = member(word, _word_hashes(list(_VALUE)))
    # Spelled digits in a row; figures, multiples and dots may stand among them.
    figure = (data[start] >= 48) & (data[start] <= 57)
    double, triple = member(word, _word_hashes(["double"])), member(word, _word_hashes(["triple"]))
    among = digit | figure | double | triple | member(word, _word_hashes(["plus", *_DOT_WORDS]))
    stands = np.where(digit, 1, np.where(figure, end - start, 0))
    stands = stands + np.append(stands[1:], 0) * (double + 2 * triple)
    part = np.cumsum(np.append(True, ~among[1:] | ~among[:-1] | (text[1:] != text[:-1]))[: len(word)]) - 1
    spelled = np.zeros(len(column), bool)
    if len(word):
        words = np.bincount(part, digit | double | triple)
        enough = (words > 0) & ((np.bincount(part, stands) >= SPELLED_RUN) | (np.bincount(part, digit | figure) >= 4))
        spelled[text[enough[part]]] = True
    return spelled, dotted


def unglyph(tape: Tape) -> Tape:
    text = tape.text.translate(_PLAIN)
    if len(text) == len(tape.text):
        return Tape(text, tape.begin, tape.end)
    kept = ~np.isin(np.frombuffer(tape.text.encode("utf-32-le", "surrogatepass"), np.uint32), _VANISHING)
    return Tape(text, tape.begin[kept], tape.end[kept])


def unspell(tape: Tape) -> Tape:
    edits = []
    for run in _SPELLED.finditer(tape.text):
        parts, many = [], 1
        for m in _PARTS.finditer(tape.text, run.start(), run.end()):
            if m["many"]:
                many = 2 if m["many"].lower() == "double" else 3
                parts.append((m.start(), m.end(), ""))
            elif m["plus"]:
                parts.append((m.start(), m.end(), "+"))
            else:
                parts.append((m.start(), m.end(), (m["figure"] or _VALUE[m["word"].lower()]) * many))
                many = 1
        gaps = [(x[1], y[0]) for x, y in zip(parts, parts[1:])]
        dots = [_DOT_GAP.fullmatch(tape.text, a, b) is not None for a, b in gaps]
        digits = [new if new.isdigit() else "" for _, _, new in parts]
        if all(new == tape.text[a:b] for a, b, new in parts) or sum(map(len, digits)) < SPELLED_RUN and sum(dots) < 3:
            continue
        together = _octets(digits, dots) if sum(dots) >= 3 else set()
        for i, (a, b, new) in enumerate(parts):
            if new != tape.text[a:b]:
                edits.append((a, b, new))
            if i == len(gaps) or gaps[i][0] == gaps[i][1]:
                continue
            if dots[i]:
                edits.append((*gaps[i], "."))
            elif i in together and not tape.text[slice(*gaps[i])].strip(" -"):
                edits.append((*gaps[i], ""))
            else:  # between two digits, commas count as spaces
                edits += [(m.start(), m.end(), " ") for m in _SPACES.finditer(tape.text, *gaps[i])]
    return tape.rewrite(edits)


def _octets(digits: list[str], dots: list[bool]) -> set[int]:
    """The gaps that vanish: those between two dots, and beside the first and last one as far as an octet goes."""
    first, last = dots.index(True), len(dots) - 1 - dots[::-1].index(True)
    out = {i for i in range(first, last) if not dots[i]}
    octet = digits[first]
    for i in range(first - 1, -1, -1):
        octet = digits[i] + octet
        if len(octet) > 3 or octet and int(octet) > 255:
            break
        out.add(i)
    octet = digits[last + 1]
    for i in range(last + 1, len(dots)):
        octet += digits[i + 1]
        if len(octet) > 3 or octet and int(octet) > 255:
            break
        out.add(i)
    return out


def _space_before(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1].isspace():
        at -= 1
    return at


def _dot_before(text: str, at: int, least: int) -> int | None:
    """Where the disguised dot begins that ends at `at`, with the space around it."""
    closed = _space_before(text, at, least)
    if closed > least and text[closed - 1] in "])}>":
        inner = _space_before(text, closed - 1, least)
        for word in (*_DOT_WORDS, "."):
            if text[max(least, inner - len(word)) : inner].lower() == word:
                opened = _space_before(text, inner - len(word), least)
                if opened > least and text[opened - 1] in "[({<":
                    return _space_before(text, opened - 1, least)
        return None
    for word in _BARE_DOTS:
        if closed < at and text[max(least, closed - len(word)) : closed].lower() == word:
            begin = _space_before(text, closed - len(word), least)
            if begin < closed - len(word):
                return begin
    return None


def _local_before(text: str, at: int, least: int) -> int:
    """Where the local part begins that ends at `at`; `at` if there is none. Three disguised dots at most."""
    found = at
    for part in range(4):
        begin = at
        while begin > least and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin == at:
            return found
        found = begin
        at = _dot_before(text, begin, least) if part < 3 else None
        if at is None:
            return found
    return found


def addresses(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(begin, begin of the at, end of the at, end) of what may be an address, plain or disguised.

    They are found from their at signs, so that no other part of the text is
    looked at twice.
    """
    free = 0
    for m in _AT.finditer(text):
        if m.start() < free:
            continue
        begin, end = m.span()
        if m[0] != "@":
            begin = _space_before(text, begin, free)
            while end < len(text) and text[end].isspace():
                end += 1
        host = _HOST.match(text, end)
        if host is None:
            continue
        local = _local_before(text, begin, free)
        if local < begin:
            free = host.end()
            yield local, begin, end, free


def unmask(tape: Tape) -> Tape:
    """Write @ and . for their disguises inside addresses."""
    text, edits, taken = tape.text, [], Cover(len(tape.text))
    for a, begin, end, b in addresses(text):
        token, rest = text[begin:end], text[end:b]
        spelled_dot = any(len(d[0]) > 1 for d in _DOT_TOKEN.finditer(rest))
        if any(part.lower() in _DOT_WORDS for part in re.findall(_LABEL, _DOT_TOKEN.sub(" . ", rest))):
            continue  # a dot word as a name: prose
        # A bare "at" counts only with a disguised dot after it.
        if token == "@" and not spelled_dot and not _BRACKET.search(text, a, b) or not (spelled_dot or "@" in token or _BRACKET.search(token)):
            continue
        head = [(d.start(), d.end(), ".") for d in _DOT_TOKEN.finditer(text, a, begin) if len(d[0]) > 1]
        tail = [(d.start(), d.end(), ".") for d in _DOT_TOKEN.finditer(text, end, b) if len(d[0]) > 1]
        edits += [*head, (begin, end, "@"), *tail]
        taken.add(a, b)
    for m in _DOTTED_IP.finditer(text):
        if not taken.meets(*m.span()):
            edits += [(d.start(), d.end(), ".") for d in _DOT_TOKEN.finditer(text, *m.span()) if len(d[0]) > 1]
    return tape.rewrite(sorted(edits))


def spans(text: str, spelled: bool = True, dotted: bool = True) -> tuple[list[Span], list[Span]]:
    """(plain spans, spans that only deobfuscation finds).

    spelled, dotted: whether the text may have spelled digits or dots.
    """
    plain = plain_spans(text)
    odd = not text.isascii() and _ODD.search(text) is not None
    if not (odd or spelled or dotted or _MASK_TRIGGER.search(text)):
        return plain, []
    tape = unmask(unspell(unglyph(Tape(text))))
    taken, added = Cover(len(text)), []
    for _, a, b in plain:
        taken.add(a, b)
    for kind, a, b in plain_spans(tape.text):
        begin, end = tape.source(a, b)
        if not taken.meets(begin, end):
            added.append((kind, begin, end))
            taken.add(begin, end)
    return plain, added


def written_out(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(found))


SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
FIELDS = [T.StructField("pii", T.ArrayType(SPAN, False)), T.StructField("pii_base", T.ArrayType(SPAN, False)), T.StructField("redacted", T.StringType())]


def redact(text: str, found: list[Span]) -> str:
    """The text with each span (or overlapping spans, as one) replaced by the first one's kind."""
    out, at = [], 0
    for kind, a, b in ordered(found):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append `pii` (all spans), `pii_base` (plain ones) and `redacted` (the
    text with kinds for spans). See the module's docstring.
    """
    arrow_span = pa.list_(pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]))

    def factory():
        def rows(found: list[Span]) -> list[dict]:
            return [{"kind": k, "start": a, "end": b} for k, a, b in ordered(found)]

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            every, base, clean = [], [], []
            column = part.column(text_col)
            for text, spelled, dotted in zip(texts(column), *triggers(column)):
                plain, added = spans(text, bool(spelled), bool(dotted))
                every.append(rows([*plain, *added]))
                base.append(rows(plain))
                clean.append(redact(text, [*plain, *added]) if plain or added else text)
            return [pa.array(every, arrow_span), pa.array(base, arrow_span), pa.array(clean, pa.string())]

        return work

    return append_columns(docs, text_col, FIELDS, factory)


def joined(spans_col: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def count(spans_col: Column, kind: str) -> Column:
    return F.size(F.filter(spans_col, lambda s: s.kind == kind)).cast("long")
