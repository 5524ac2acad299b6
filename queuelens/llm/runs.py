"""Runs of repeated words: stretches of consecutive words with a period, all of them, in whole texts.

Words are what white space of ASCII separates. A run of period q is a stretch
in which words q apart are equal, q being the smallest such number, that is at
least `times` * q and `least` words long and that no neighbouring word extends.

For each period p up to a `times`-th of the text, the positions 0, p, 2p, ...
form a grid. A run of `times` periods covers as many grid points in a row, so
an anchor is a grid point from which so many words of the grid are equal (and,
as a cheap further test, those half a period on). At every anchor jp the
longest common extensions of jp and (j + 1)p, forward and backward, give the
run around it. Extensions are range minima over the common prefixes of
neighbours in a suffix array, backward ones over that of the reversed words.
A stretch found with several periods has the smallest one: the others are its
multiples.

Work is per text, without a shuffle; numpy handles the words of many texts in
one array. A text of n words takes n log n grid points, in pieces of `GRID`.

Odd input: null and empty texts, and texts of white space, have no words and
no runs; repeated rows each get their own; columns of the table keep their
place, but for those named like a new one, which are replaced. Texts may be of
any length; bytes of 128 and more belong to words. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from queuelens.llm.common import append_columns
from queuelens.llm.textstats import buffers, equal_words, hashes, spans

#: Grid points that are held at a time.
GRID = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
FIELDS = [T.StructField("n_words", T.LongType(), False), T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False)]


class Extensions:
    """Longest common extensions to the right of any two positions of an array."""

    def __init__(self, x: np.ndarray) -> None:
        # Prefix doubling; level l has the names of all stretches of 2**l, past the end comes one more name.
        size = len(x)
        name = np.unique(x, return_inverse=True)[1].astype(np.int64)
        levels, width = [np.append(name, -1)], 1
        while True:
            after = np.full(size, -1, np.int64)
            after[: max(0, size - width)] = name[width:]
            key = name * (size + 1) + after + 1
            order = np.argsort(key, kind="stable")
            new = np.zeros(size, np.int64)
            new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            name, width = new, width * 2
            if size == 0 or name[order[-1]] == size - 1:
                break
            levels.append(np.append(name, -1))
        self.rank = name
        # Common prefixes of neighbours in the suffix array, from the longest stretch down.
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, size - 1), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            same = levels[level][a] == levels[level][b]
            for y in (a, b, common):
                y[same] += 1 << level
        self.minima = [np.append(0, common).astype(np.int32)]
        while (half := 1 << (len(self.minima) - 1)) * 2 <= size:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: len(last) - half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different positions, how many words from there on agree."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.minima[k]
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << k) + 1])
        return out


def _pieces(sizes: np.ndarray):
    """Slices of the rows whose sizes sum up to about `GRID`."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + GRID, side="right")))
        yield slice(start, end)
        start = end


def _anchors(x: np.ndarray, offsets: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of all anchors; texts lie between `offsets`."""
    length = np.diff(offsets)
    most = length // times
    text = np.repeat(np.arange(len(length)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (length[text] - 1) // period + 1
    found = []
    for part in _pieces(points):
        count, p = points[part], period[part]
        first = np.cumsum(count) - count
        step = np.repeat(p, count)
        at = np.repeat(offsets[text[part]], count) + (np.arange(len(step)) - np.repeat(first, count)) * step
        word = x[at]
        same = np.zeros(len(at) + times, bool)
        same[: len(at) - 1] = word[1:] == word[:-1]
        same[first + count - 1] = False  # the last point of a grid has no next one
        good = same[: len(at)].copy()
        for k in range(1, times - 1):
            good &= same[k : k + len(at)]
        at, step = at[good], step[good]
        if times > 2:
            half = step // 2
            further = x[at + half] == x[at + half + step]
            at, step = at[further], step[further]
        found.append((at, step))
    return tuple(np.concatenate(z) if found else np.zeros(0, np.int64) for z in (zip(*found) if found else ((), ())))


def find(x: np.ndarray, offsets: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period; texts of word numbers lie in `x` between `offsets`."""
    at, period = _anchors(x, offsets, times)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    # Only texts with an anchor are indexed, each behind a separator that occurs once.
    text = np.searchsorted(offsets, at, side="right") - 1
    used, place = np.unique(text, return_inverse=True)
    size = np.diff(offsets)[used]
    start = np.cumsum(size + 1) - size
    joined = np.full(int(size.sum()) + len(used) + 1, -1, np.int64)
    inside = np.ones(len(joined), bool)
    inside[np.append(start - 1, len(joined) - 1)] = False
    flat = np.arange(int(size.sum())) + np.repeat(offsets[used] - (np.cumsum(size) - size), size)
    joined[inside] = x[flat]
    joined[~inside] = x.max() + 1 + np.arange(len(used) + 1)
    move = offsets[used][place] - start[place]
    i = at - move
    forward, backward, last = Extensions(joined), Extensions(joined[::-1]), len(joined) - 1
    high = i + period + forward(i, i + period) + move
    low = i - backward(last - (i - 1), last - (i + period - 1)) + move
    fine = high - low >= np.maximum(least, times * period)
    low, high, period = low[fine], high[fine], period[fine]
    order = np.lexsort((period, high, low))
    low, high, period = low[order], high[order], period[order]
    once = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(low)]
    low, high, period = low[once], high[once], period[once]
    order = np.lexsort((period, low))
    return low[order], high[order], period[order]


def _numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    _, first, number = np.unique(hashes(data, start, end), return_index=True, return_inverse=True)
    if equal_words(data, start, end, data, start[first][number], end[first][number]).all():
        return number
    seen: dict[bytes, int] = {}  # two words share a hash
    raw = data.tobytes()
    return np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(start, end, strict=True)], np.int64)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, texts: int) -> pa.Array:
    """Each text's words with one space between them."""
    size = end - start + 1
    to = np.cumsum(size)
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    flat = np.arange(int((size - 1).sum()))
    within = np.cumsum(size - 1) - (size - 1)
    shift = np.repeat(to - size - within, size - 1)
    out[flat + shift] = data[flat + np.repeat(start - within, size - 1)]
    final = np.append(text[1:] != text[:-1], True)[: len(text)]  # no space after a text's last word
    keep = np.ones(len(out), bool)
    keep[to[final] - 1] = False
    count = np.bincount(text, size - 1, texts) + np.maximum(np.bincount(text, minlength=texts) - 1, 0)
    offsets = np.append(0, np.cumsum(count)).astype(np.int32)
    return pa.StringArray.from_buffers(texts, pa.py_buffer(offsets), pa.py_buffer(out[keep]))


def _worker(at: int, least: int, times: int):
    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = buffers(batch.column(at))
        start, end, text = spans(~_SPACE[data], offsets)
        words = np.append(0, np.cumsum(np.bincount(text, minlength=len(batch))))
        low, high, period = find(_numbered(data, start, end), words, least, times)
        of = np.searchsorted(words, low, side="right") - 1
        each = np.append(0, np.cumsum(np.bincount(of, minlength=len(batch)))).astype(np.int32)
        change = np.zeros(len(start) + 1, np.int64)
        np.add.at(change, low + period, 1)
        np.add.at(change, high, -1)
        kept = np.cumsum(change)[:-1] == 0
        found = pa.StructArray.from_arrays([pa.array(z) for z in (low - words[of], high - low, period)], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
        listed = pa.ListArray.from_arrays(pa.array(each), found, type=pa.list_(pa.field("element", found.type, False)))
        return [pa.array(np.diff(words)), listed, _joined(data, start[kept], end[kept], text[kept], len(batch))]

    return work


def runs(docs: DataFrame, column: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """`docs` with `n_words`, `runs` (start, length, period; by start and period) and `collapsed`.

    `collapsed` is the text without the words that some run repeats, each run's
    first period stays; its words are joined by one space.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has at least two periods and a word")
    names = [c for c in docs.columns if c not in {f.name for f in FIELDS}]
    return append_columns(docs, column, FIELDS, lambda: _worker(names.index(column), least, times))
