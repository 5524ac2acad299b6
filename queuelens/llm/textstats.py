"""Vectorised word and line statistics over the UTF-8 buffer of many texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the rolling hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


class _Powers:
    """BASE**i and BASE**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = np.full(size, BASE, np.uint64), np.full(size, BASE_INVERSE, np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts in them); nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the maximal runs of `inside` bytes in each text."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True  # texts begin anew
    start = np.flatnonzero(inside & np.append(True, ~inside[:-1] | edge[1:-1]))
    end = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes; it depends on its bytes and length alone."""
    up, down = _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] ^ mix((end - start).astype(np.uint64)))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values in each text."""
    total = np.append(0, np.cumsum(values, dtype=np.float64))
    return total[offsets[1:]] - total[offsets[:-1]]


def member(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which values are among a few others."""
    few = np.unique(few)
    return few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values


def equal_words(a: np.ndarray, start: np.ndarray, end: np.ndarray, b: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each stretch of `a` has the same bytes as its stretch of `b`."""
    size = end - start
    same = size == other_end - other
    check = np.flatnonzero(same & (size > 0))
    if not len(check):
        return same
    size = size[check]
    first = np.cumsum(size) - size
    flat = np.arange(int(size.sum()))
    equal = a[flat + np.repeat(start[check] - first, size)] == b[flat + np.repeat(other[check] - first, size)]
    same[check] = np.logical_and.reduceat(equal, first)
    return same
