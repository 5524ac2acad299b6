"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of block
tags. Per path, text length and punctuation are summed and divided by the
number of blocks: the path's text ratio (of text outside links) and its
punctuation ratio, fused into one. Names are only a prior on it: what lies in
elements that are menus, headers, footers, sidebars, dialogs or forms by their
tag has weight 0, what is marked so by class, id or role has weight `MARKED`.
The fused ratio of a block's path is smoothed along the page with a Gaussian
window that does not reach over the ends of a container.

Content nodes follow from the ratios. Blocks whose smoothed ratio reaches
`THRESHOLD` of the best one are the core; the lowest container that holds the
core is the content node. Where `article` and `main` elements hold most of the
weighted text (text in them counts `NAMED` times), they are the content nodes.
In a content node everything is kept whose weight is that of the core and that
is of no menu, by the ratios of its path in its own parent: several blocks, no
headings, `MENU` of their text in links, and less than a mark of punctuation
each. Lists, tables, headings and short paragraphs stay.

Results, also for odd input:

* null, empty and text-free pages give an empty text;
* character references are decoded, white space in a block becomes one space,
  blocks are trimmed and joined by one space in page order;
* tags, attributes and comments are cut as browsers cut them (quotes count
  after an equals sign alone; what follows a tag that never ends is lost);
  unclosed and stray tags are read as far as blocks are concerned;
* adverts and hidden parts go also as inline elements within a block;
* pages of any length and depth are read whole, in linear time; repeated rows
  give equal results;
* an empty table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from queuelens.llm.common import append_columns, texts

#: Elements by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset("nav footer aside form header head button select option datalist svg math canvas object audio video dialog menu".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "head": frozenset(["body"]),
}
#: Words in class, id or role that mark a part as no content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead sidebar aside complementary contentinfo search toolbar share sharing social related recommended widget "
    "comment comments disqus respond replies reply hidden".split()
)
#: Words that say where or how a part is, beside a mark.
BESIDE = frozenset(
    "site main top bottom left right page global primary secondary mobile desktop sticky fixed floating inline bar list lists box boxes form links link items item block blocks section area wrapper wrap container inner outer "
    "panel pane header head title body content group row column col widget widgets posts post articles stories entries topics buttons button icons icon thread count text unit slot region zone policy message dialog window".split()
)
CONTENT = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section article main body html".split())
#: Part of the best smoothed ratio that makes a block one of the core.
THRESHOLD = 0.25
#: How much text in article and main counts against text elsewhere.
NAMED = 4
#: Weight of what a name marks as no content.
MARKED = 0.02
#: Share of link text that makes the blocks of a path in one element a menu.
MENU = 0.8
_W = r" \t\n\f\r"
# Possessive throughout: no character is read again.
_VALUE = rf"(?>\"[^\"]*+\"|'[^']*+'|(?![\"'])[^{_W}>]++)"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^{_W}/>]*+)((?>[{_W}/]++|=?[^{_W}/>=]++(?>[{_W}]*+=[{_W}]*+{_VALUE}?+)?+|=)*+)>")
_ATTRIBUTE = re.compile(rf"(=?[^{_W}/>=]++)(?>[{_W}]*+=[{_W}]*+({_VALUE})?+)?+")
_COMMENT_END = re.compile(r"--!?>")
_NONE = re.compile(r"display\s*:\s*none")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.,;:!?。，；：！？…]")
_ZEROS = re.compile(r"&#([xX]?)0{6,}+")
_HUGE = re.compile(r"&#(?:[xX][0-9a-fA-F]{7,}+|[0-9]{8,}+);?")


def attributes(text: str) -> list[tuple[str, str]]:
    """(name, value) of the attributes in a tag; names in lower case."""
    found = []
    for m in _ATTRIBUTE.finditer(text):
        value = m[2] or ""
        found.append((m[1].lower(), value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def _hidden(name: str, value: str) -> bool:
    return name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _NONE.search(value) is not None


def _is_mark(name: str) -> bool:
    """Whether a name consists of a mark, or of marks and words that say where or how: "left-sidebar", not "search-algorithms"."""
    words = [w.lower() for w in _NAME.findall(name)]
    return any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words)


def marked(text: str) -> bool:
    """Whether an element's attributes say that it is no content."""
    for name, value in attributes(text) if text else ():
        if _hidden(name, value) or name in ("class", "id", "role") and any(map(_is_mark, value.split())):
            return True
    return False


def named_so(text: str) -> bool:
    """Whether an outermost article is no content: hidden, or with a whole name that is a mark.

    Names such as comments-open speak of the page that the article is.
    """
    for name, value in attributes(text):
        if _hidden(name, value) or name in ("class", "id", "role") and any(re.sub(r"[-_]?[0-9]+$", "", w.lower()) in MARKS for w in value.split()):
            return True
    return False


def decoded(raw: str) -> str:
    """Text with its character references decoded; numbers of any length are read."""
    if "&" not in raw:
        return raw
    return unescape(_HUGE.sub("�", _ZEROS.sub(r"&#\g<1>0", raw)) if "&#" in raw else raw)


class Element:
    """A block element. first, end: the blocks in it; box: its nearest container."""

    __slots__ = ("tag", "up", "depth", "path", "inside", "weight", "first", "end", "box")

    def __init__(self, tag: str, up: Element | None, path: int, inside: bool, weight: float, first: int):
        self.tag, self.up, self.path, self.inside, self.weight, self.first = tag, up, path, inside, weight, first
        self.depth, self.end = (up.depth + 1 if up else 0), None
        self.box: Element = self if up is None or tag in CONTAINERS else up.box


class Block:
    __slots__ = ("element", "text", "links")

    def __init__(self, element: Element):
        self.element, self.links = element, 0
        self.text: list[str] = []


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, each with the element it is in."""
    root = Element("", None, 0, False, 1.0, 0)
    out: list[Block] = []
    stack, opened, paths = [root], Counter(), {}
    block: Block | None = None
    # Depth at which an <a>, or a marked inline element, was opened; what is open since in the latter.
    link, mute, muted = None, None, []
    at, size = 0, len(page)

    def add(raw: str) -> None:
        nonlocal block
        if mute is not None:
            return
        if block is None:
            if raw.isspace():
                return
            block = Block(stack[-1])
            out.append(block)
        block.text.append(raw)
        if link is not None:
            block.links += len(raw)

    def pop() -> None:
        nonlocal link, mute
        gone = stack.pop()
        gone.end = len(out)
        opened[gone.tag] -= 1
        if link is not None and link > len(stack):
            link = None
        if mute is not None and mute > len(stack):
            mute = None
            muted.clear()

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        after = page[begin + 1 : begin + 3]
        if not (after[:1].isascii() and after[:1].isalpha() or after[:1] in ("!", "?", "/")) or not after or after == "/":
            add(page[at : begin + 1])  # a sign, no tag
            at = begin + 1
            continue
        if begin > at:
            add(page[at:begin])
        if page.startswith("<!--", begin):
            if page.startswith((">", "->"), begin + 4):
                at = page.find(">", begin) + 1
            else:
                end = _COMMENT_END.search(page, begin + 4)
                at = end.end() if end else size
            continue
        m = _TAG.match(page, begin)
        if m is None:
            # A declaration, or a tag that never ends.
            close = page.find(">", begin) if after[:1] in ("!", "?") or after[:1] == "/" and not after[1:].isalpha() else -1
            at = close + 1 if close >= 0 else size
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag == "a":
                link = None
            if tag in INLINE:
                if tag in muted:
                    while muted.pop() != tag:
                        pass
                    if not muted:
                        mute = None
                continue
            block = None
            if opened[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            if end is None:
                break
            close = page.find(">", end.end() - 1)
            at = close + 1 if close >= 0 else size
            if tag != "noscript":
                block = None
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                block = None
            continue
        if tag in INLINE:
            if tag == "a":
                link = len(stack)
            if mute is not None:
                muted.append(tag)
            elif marked(m[3]):
                mute = len(stack)
                muted.append(tag)
            continue
        block = None
        while tag in CLOSED_BY.get(stack[-1].tag, ()):
            pop()
        if m[3].endswith("/") and tag in ("svg", "path", "math"):
            continue
        up = stack[-1]
        weight = up.weight
        if tag in SKIPPED and not (tag == "header" and up.inside):
            weight = 0.0
        elif mute is not None:
            weight *= MARKED
        elif tag == "article" and not up.inside:
            weight *= MARKED if named_so(m[3]) else 1  # what marks the whole page says nothing about its parts
        elif (tag not in ("html", "body", "article", "main") or up.inside) and marked(m[3]):
            weight *= MARKED
        path = paths.setdefault((up.path, tag), len(paths) + 1)
        stack.append(Element(tag, up, path, up.inside or tag in CONTENT and weight == 1, weight, len(out)))
        opened[tag] += 1
    while stack:
        pop()
    return out


def _container(a: Element, b: Element) -> Element:
    """The lowest container that holds both elements."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
    return a.box


def _totals(keys: list, *values: np.ndarray) -> list[np.ndarray]:
    """For each block: how many share its key, and the sums of the values over them."""
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    path = np.array([number[k] for k in keys])
    return [np.bincount(path, v, len(number))[path] for v in (np.ones(len(path)), *values)]


def ratios(found: list[Block], length: np.ndarray, marks: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fused ratio of its path, whether it is of a menu) for each block."""
    n, chars, linked, points = _totals([(b.element.path, b.element.weight) for b in found], length, links, marks)
    fused = (chars - linked) / n * (1 + points / n)
    # The blocks of a path in one element: a list, say.
    n, chars, linked, points = _totals([(b.element.path, id(b.element.up)) for b in found], length, links, marks)
    heading = np.array([b.element.tag in HEADINGS for b in found])
    return fused, (n > 1) & (linked >= MENU * chars) & (points < n) & ~heading


def smoothed(ratio: np.ndarray, container: list) -> np.ndarray:
    """Gaussian smoothing over neighbouring blocks of the same container."""
    weight = np.exp(-0.5 * np.arange(3) ** 2)
    total, norm = ratio * weight[0], np.full(len(ratio), weight[0])
    number = {c: k for k, c in enumerate(dict.fromkeys(container))}
    group = np.array([number[c] for c in container])
    for step in (1, 2):
        if len(ratio) > step:
            same = group[step:] == group[:-step]
            total[:-step] += weight[step] * ratio[step:] * same
            norm[:-step] += weight[step] * same
            total[step:] += weight[step] * ratio[:-step] * same
            norm[step:] += weight[step] * same
    return total / norm


def content(page: str) -> str:
    """The main text of a page."""
    found = blocks(page)
    text = [" ".join("".join(map(decoded, b.text)).split()) for b in found]
    length = np.array([len(t) for t in text], float)
    weight = np.array([b.element.weight for b in found])
    if not (weight * length).any():
        return ""
    marks = np.array([len(_MARKS.findall(t)) for t in text], float)
    links = np.minimum(length, [b.links for b in found])
    inside = np.array([b.element.inside for b in found])
    ratio, menu = ratios(found, length, marks, links)
    ratio = ratio * weight
    smooth = smoothed(ratio, [id(b.element.box) for b in found])
    mass = length * weight * (ratio > 0)
    if NAMED * mass[inside].sum() > mass[~inside].sum():
        scope = inside
    else:
        scope = np.zeros(len(found), bool)
        core = np.flatnonzero((ratio > 0) & (smooth >= THRESHOLD * smooth.max()))
        if len(core):
            low = _container(found[core[0]].element, found[core[-1]].element)
            scope[low.first : low.end] = True
    if not (scope & (weight > 0)).any():
        scope = weight > 0
    keep = scope & (weight >= weight[scope].max())
    if not menu[keep].all():
        keep &= ~menu
    return " ".join(t for t, k in zip(text, keep) if k and t)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Append the main text of each page. See the module's docstring."""

    def factory():
        return lambda part: [pa.array([content(x) for x in texts(part.column(html_col))], pa.string())]

    return append_columns(pages, html_col, [T.StructField(out_col, T.StringType())], factory)
