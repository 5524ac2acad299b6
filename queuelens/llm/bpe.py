"""Byte-pair encoding and decoding with batched numpy merge rounds.

The vocabulary file of a public tokenizer is a parameter. A batch of texts is
cut at white space into chunks; chunks that the worker has not met yet are
split into words, which are laid out as one flat array of symbols. Each round forms the pairs of neighbouring symbols,
finds their merge ranks by binary search over the sorted pair keys, takes for
every word its lowest rank, and merges all places that have it, left to right.
Rounds end when no pair of any word can merge.

Results, also for odd input:

* a null text is encoded as the empty text, so `ids` is an empty array;
* empty texts give empty arrays; texts of any length are encoded whole;
* strings of special tokens in a text become the special ids, as the
  tokenizers library does by default;
* repeated rows give repeated results; tables without rows stay so;
* columns that already have the name of an output column are replaced, all
  others pass through unchanged;
* decoding null gives null; ids outside the vocabulary are skipped.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from queuelens.llm.common import append_columns, texts
from queuelens.llm.textstats import buffers

#: Words that a worker remembers before it starts afresh.
CACHE_WORDS = 500_000
#: Ids of remembered chunks, which bound their bytes as well, as tokens are short.
CACHE_IDS = 4_000_000
#: The splitting pattern of byte-level tokenizers.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for characters below U+0250, where these are all letters, numbers and white space.
NARROW_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{W}{L}{N}]+|[{W}]+(?![^{W}])|[{W}]+".format(L="A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", N="0-9\xb2\xb3\xb9\xbc-\xbe", W="\t-\r \x85\xa0")
#: RE2: chunks that can't be split in one go, with a return between them: others than such characters, or white space that meets the return.
ALONE = r"^[\s\x0b\x{85}\x{a0}]{2}|[\s\x0b\x{85}\x{a0}]$|[\r\x{250}-\x{10ffff}]"
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: RE2: a space before white space or the end, where cutting at it would cut a run of white space, or an odd separator.
UNEVEN = r" (?:[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)|[\x1c-\x1f]"


_narrow = re.compile(NARROW_PATTERN).findall


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


def _steps(node: dict | None, key: str) -> list[dict]:
    if node is None:
        return []
    return node[key] if node["type"] == "Sequence" else [node]


class Bpe:
    """Encoder and decoder of one vocabulary file (JSON of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._find, self._chunk = self._splitter(_steps(spec["pre_tokenizer"], "pretokenizers"))
        # Runs of white space need no squeezing where white space is dropped.
        dropped = self._chunk == str.split
        #: Whether words take one space from the left, and no other text is changed, so that even texts are cut before each space.
        self._spaced = not dropped and not spec["normalizer"]
        steps = [n for n in _steps(spec["normalizer"], "normalizers") if not (dropped and n.get("content") == " " and n["pattern"] == {"Regex": "\\s+"})]
        self._normal = [self._normalizer(n) for n in steps]
        self.byte_decoder = bool(spec["decoder"]) and spec["decoder"]["type"] == "ByteLevel"
        # Pair keys, sorted, with the rank and the result of each merge.
        self.base = max([*self.vocab.values(), *self.special.values()]) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        symbols = byte_symbols()
        self.byte_ids = np.array([self.vocab[s] for s in symbols], np.int64)
        self.last_ids = np.array([self.vocab[s + self.suffix] for s in symbols], np.int64)
        tokens: list[str | None] = [None] * self.base
        for t, i in [*self.vocab.items(), *self.special.items()]:
            tokens[i] = t
        self.known = np.array([t is not None for t in tokens])
        if self.byte_decoder:
            back = {s: b for b, s in enumerate(symbols)}
            raw = [b"" if t is None else t.encode() if t in self.special else bytes(back[c] for c in t) for t in tokens]
            self.pieces = pa.array(raw, pa.binary())
        else:
            self.pieces = pa.array(["" if t is None else t for t in tokens], pa.string())
        self._reset()

    # -- words ------------------------------------------------------------
    @staticmethod
    def _normalizer(step: dict):
        kind = step["type"]
        if kind in ("NFC", "NFD", "NFKC", "NFKD"):
            return lambda s: s if s.isascii() else unicodedata.normalize(kind, s)
        if kind == "Replace":
            pattern, content = step["pattern"], step["content"]
            if "String" in pattern:
                return lambda s: s.replace(pattern["String"], content)
            found = regex.compile(pattern["Regex"], regex.V0)
            return lambda s: found.sub(content, s)
        if kind == "Lowercase":  # character by character, so no final sigma
            return lambda s: s.replace("Σ", "σ").lower()
        raise ValueError(f"normalizer {kind} is not supported")

    @staticmethod
    def _splitter(steps: list[dict]):
        """(the function that splits a chunk into words, the one that cuts a text into chunks).

        No word reaches over a chunk's end: words either hold no white space,
        or take it from the run just before them.
        """
        found = []
        for step in steps:
            if step["type"] == "Split" and step["invert"] and step["behavior"] == "Removed":
                pattern = regex.compile(step["pattern"]["Regex"])
                if pattern.search(" \n\t"):
                    raise ValueError("splitting patterns that keep white space are not supported")
                found.append((pattern.findall, str.split))
            elif step["type"] == "ByteLevel" and not step["add_prefix_space"]:
                if step["use_regex"]:
                    found.append((regex.compile(BYTE_LEVEL_PATTERN).findall, re.compile(r"\s*\S+|\s+").findall))
            else:
                raise ValueError(f"pre-tokenizer {step} is not supported")
        if len(found) != 1:
            raise ValueError("exactly one splitting pattern is supported")
        return found[0]

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text; a special token is a chunk with a NUL before it.

        NUL is never followed by a special token inside another chunk, as the
        text is cut at special tokens first.
        """
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append("\0" + m[0])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        for step in self._normal:
            text = step(text)
        # The separators FS to US are white space for Python alone.
        return [text] if text and ODD_SPACE.search(text) else self._chunk(text)

    # -- merging ----------------------------------------------------------
    def _reset(self) -> None:
        self.index = {"\0" + t: k for k, t in enumerate(self.special)} | {"": len(self.special)}
        self.flat = np.array(list(self.special.values()), np.int32)
        self.start = np.append(np.arange(len(self.special), dtype=np.int64), 0)
        self.length = np.append(np.ones(len(self.special), np.int64), 0)

    def merged(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number of ids of each word."""
        if not len(new):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        data, offsets = buffers(new)
        size = np.diff(offsets)
        symbol = self.byte_ids[data]
        ends = offsets[1:] - 1
        symbol[ends] = self.last_ids[data[ends]]
        word = np.repeat(np.arange(len(size)), size)
        never = len(self.keys)
        merge = np.full(len(symbol), never, np.int32)  # of each pair, by its first symbol: where its key stands
        rank = np.full(len(symbol), never, np.int32)

        def look_up(at: np.ndarray) -> None:
            """Find the merges of the pairs that begin at the given places."""
            at = at[at + 1 < len(symbol)]
            at = at[word[at] == word[at + 1]]
            key = symbol[at] * self.base + symbol[at + 1]
            found = np.minimum(np.searchsorted(self.keys, key), never - 1)
            hit = self.keys[found] == key
            merge[at] = np.where(hit, found, never)
            rank[at] = np.where(hit, self.rank[found], never)

        done_symbol, done_word = [], []
        look_up(np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            own_least = np.repeat(least, np.diff(np.append(first, len(word))))
            stay = own_least < never
            if not stay.all():  # words that are complete leave the array
                done_symbol.append(symbol[~stay])
                done_word.append(word[~stay])
                symbol, word, merge, rank, own_least = symbol[stay], word[stay], merge[stay], rank[stay], own_least[stay]
            hit = np.flatnonzero(rank == own_least)
            # Of hits that overlap (runs of neighbours), every second one counts.
            run = np.append(True, np.diff(hit) != 1)[: len(hit)]
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbol[hit] = self.made[merge[hit]]
            kept = np.ones(len(symbol), bool)
            kept[hit + 1] = False
            merge[hit] = rank[hit] = never
            symbol, word, merge, rank = symbol[kept], word[kept], merge[kept], rank[kept]
            # Only pairs with a new symbol need another look.
            new_at = np.cumsum(kept)[hit] - 1
            before = new_at[new_at > 0] - 1
            merge[before] = rank[before] = never
            look_up(np.concatenate([new_at, before]))
        symbol = np.concatenate([*done_symbol, symbol])
        word = np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(word, minlength=len(size))

    def _learn(self, new: list[str]) -> None:
        """Encode chunks that were not met before and remember their ids.

        All that can be are split in one go, with a return between them that is a word of its own.
        """
        alone = np.ones(len(new), bool)
        if self._spaced:
            alone = pc.match_substring_regex(pa.array(new, pa.string()), ALONE).to_numpy(zero_copy_only=False)
        joined = np.flatnonzero(~alone).tolist()
        alone = np.flatnonzero(alone).tolist()
        words = _narrow("\r".join(map(new.__getitem__, joined))) if joined else []
        cut = len(words)
        counts = np.zeros(len(alone), np.int64)
        for i, k in enumerate(alone):
            own = self._find(new[k])
            counts[i] = len(own)
            words += own
        coded = pa.array(words, pa.string()).dictionary_encode()
        at, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if joined:
            between = np.append(at[:cut] == pc.index(distinct, "\r").as_py(), np.zeros(len(at) - cut, bool))
            counts = np.append(np.diff(np.concatenate([[-1], np.flatnonzero(between), [cut]])) - 1, counts)
            at = at[~between]
        flat, length = self.merged(distinct)
        start = np.cumsum(length) - length
        ends = np.append(0, np.cumsum(length[at]))
        ids = flat[np.repeat(start[at] - ends[:-1], length[at]) + np.arange(ends[-1])]
        bounds = ends[np.append(0, np.cumsum(counts))]
        known = len(self.index)
        self.index.update(zip(map(new.__getitem__, joined + alone), range(known, known + len(new))))
        self.start = np.concatenate([self.start, len(self.flat) + bounds[:-1]])
        self.length = np.concatenate([self.length, np.diff(bounds)])
        self.flat = np.concatenate([self.flat, ids])

    def _met(self, found: list[str]) -> np.ndarray:
        """Where the ids of chunks are remembered; those that are new are learned."""
        at = np.fromiter(map(self.index.get, found, repeat(-1)), np.int64, len(found))
        if len(unmet := np.flatnonzero(at < 0)):
            self._learn(list(dict.fromkeys(map(found.__getitem__, unmet))))
            at[unmet] = [self.index[found[i]] for i in unmet]
        return at

    def forget(self) -> None:
        """Give the memory of remembered chunks back."""
        self._reset()

    def _bound(self) -> None:
        if len(self.index) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self._reset()

    def _gather(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of remembered chunks, and offsets of the texts that have so many of them."""
        length = self.length[at]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - (ends - length), length) + np.arange(total)]
        word_ends = np.append(0, ends)
        return ids, word_ends[np.append(0, np.cumsum(counts))]

    def encode_batch(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as one flat int32 array, offsets of the texts in it)."""
        self._bound()
        found, counts = self._cut(batch)
        return self._gather(self._met(found), counts)

    def _cut(self, batch: list[str]) -> tuple[list[str], np.ndarray]:
        """Chunks of all texts, and the number of chunks of each."""
        found: list[str] = []
        counts = np.zeros(len(batch), np.int64)
        for i, text in enumerate(batch):
            chunks = self.chunks(text)
            counts[i] = len(chunks)
            found += chunks
        return found, counts

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`encode_batch` of an Arrow column of texts, nulls as empty ones.

        Even texts are cut before each space by Arrow, and only distinct pieces
        become Python strings.
        """
        column = pc.fill_null(column, "")
        if not self._spaced:
            return self.encode_batch(column.to_pylist())
        self._bound()
        uneven = pc.match_substring_regex(column, UNEVEN)
        for token in self.special:
            uneven = pc.or_(uneven, pc.match_substring(column, token))
        uneven = uneven.to_numpy(zero_copy_only=False)
        even = column.filter(pa.array(~uneven))
        lists = pc.split_pattern(even, " ")
        many = pc.list_value_length(lists).to_numpy()
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        heads = np.cumsum(many) - many
        tail = np.ones(len(code), bool)
        tail[heads] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[code[tail]] = True
        strings = coded.dictionary.to_numpy(zero_copy_only=False)
        after = [" " + p for p in strings[used].tolist()]
        first = strings[code[heads]].tolist()
        odd, counts = self._cut(column.filter(pa.array(uneven)).to_pylist())
        met = self._met(after + first + odd)
        place = np.zeros(len(used), np.int64)
        place[used] = met[: len(after)]
        at = place[code]
        at[heads] = met[len(after) : len(after) + len(first)]
        total = np.zeros(len(column), np.int64)
        total[~uneven], total[uneven] = many, counts
        every = np.zeros(int(total.sum()), np.int64)
        own = np.repeat(uneven, total)
        every[~own], every[own] = at, met[len(after) + len(first) :]
        return self._gather(every, total)

    # -- decoding ---------------------------------------------------------
    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """Texts of arrays of ids; special tokens are kept."""
        offsets = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(offsets) else np.zeros(0, np.int64)
        offsets = offsets - (offsets[0] if len(offsets) else 0)
        fine = (ids >= 0) & (ids < self.base)
        fine &= self.known[np.where(fine, ids, 0).astype(np.int64)]
        if not fine.all():
            offsets = np.append(0, np.cumsum(fine))[offsets]
            ids = ids[fine]
        pieces = self.pieces.take(pa.array(ids))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces), b"" if self.byte_decoder else " ")
        if self.byte_decoder:
            joined = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
        return pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.string())) if lists.null_count else joined


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One encoder for each file and Python worker."""
    return Bpe(path)


def encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Append the array of token ids of each whole text. See the module's docstring."""

    def factory():
        bpe = load(path)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            ids, offsets = bpe.encode_batch(texts(part.column(text_col)))
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

        return work

    return append_columns(df, text_col, [T.StructField(out_col, T.ArrayType(T.IntegerType(), False))], factory)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Append the text that the ids stand for. See the module's docstring."""
    schema = T.StructType([*df.drop(out_col).schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        bpe = load(path)
        for batch in batches:
            lists = batch.column(ids_col)
            sizes = np.diff(lists.offsets.to_numpy())
            # About a million ids at a time.
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) >> 20)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                out = [bpe.decode_lists(part.column(ids_col))] if part.num_rows else [pa.array([], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=schema.names)

    return df.drop(out_col).mapInArrow(run, schema)
