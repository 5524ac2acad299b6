"""Rows picked per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The latest row of each key; of equal times the one with the larger `tie`.

    An aggregate that tasks combine before the shuffle, so that a hot key
    moves one row per task.
    """
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(time, tie)).alias("row")
    return df.groupBy(key).agg(best).select(key, "row.*").select(df.columns)


def top_counts(df: DataFrame, value: str, kind: str, k: int) -> DataFrame:
    """(kind, value, count) of the k most frequent values; ties by value."""
    counted = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(k).select(F.lit(kind).alias("kind"), "value", "count")


def one_of(column: str, values: list[str] | tuple[str, ...]) -> Column | None:
    """A condition, or None where an empty list means that there is none."""
    return F.col(column).isin(*values) if values else None


def where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df
