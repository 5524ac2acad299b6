"""Shared handling of embedding columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64) if len(column) else np.zeros(0)
    size = np.diff(offsets)
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def map_groups(df: DataFrame, key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Hand `work` tables that hold whole groups of equal, non-null `key`, in order of the key.

    Meant for groups of bounded size: a task holds a batch and one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if not cut and held and held[-1].column(key)[-1].as_py() != batch.column(key)[0].as_py():
                yield from work(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the number of keys."""
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
