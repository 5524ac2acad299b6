"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from queuelens.sources.shared import shared_dir, written  # noqa: F401  (the operators' own names for them)

#: Text handled at a time inside a Python worker, in bytes. It bounds the
#: worker's memory whatever the number of rows in an Arrow batch.
SLICE_BYTES = 1 << 20


#: Data that Spark sends to a Python worker at a time, in bytes.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """`df` itself; its session now sends batches of about `BATCH_BYTES` to Python.

    By default Spark bounds a batch by its rows alone, so that long texts take
    memory on both sides. A limit that the session has already stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_LIMIT, None) is None:
        conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return df


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive zero-copy slices whose `column` holds about `limit` bytes.

    A row larger than the limit gets a slice of its own.
    """
    if batch.num_rows == 0:
        return
    sizes = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    yield batch.slice(start)


def append_columns(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    factory: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """`df` with `fields` appended, computed from slices of `column`.

    `factory` runs once in each task and returns the function that maps a
    slice to one Arrow array per field. Columns of `df` that have the name of
    a new field are replaced by it.
    """
    names = [f.name for f in fields]
    kept = df.drop(*names)
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part)], names=schema.names)

    return in_small_batches(kept).mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; nulls become empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as make it a name that `df` lacks (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows
