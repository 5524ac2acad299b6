"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders made, in order, by application.
_MADE: dict[str, list[str]] = {}


#: Those of the innermost `scope`, if there is one.
_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


def _made(spark: SparkSession) -> list[str]:
    own = _OWN.get()
    return _MADE.setdefault(spark.conf.get("spark.app.id", ""), []) if own is None else own


@contextmanager
def scope() -> Iterator[None]:
    """Folders made inside are counted, and cleared, for themselves: `clear` inside touches no folder of another query of the session.

    Folders that are left at the end count to what is around.
    """
    outer, own = _OWN.get(), []
    token = _OWN.set(own)
    try:
        yield
    finally:
        _OWN.reset(token)
        if own and outer is not None:
            outer.extend(own)
        elif own and (spark := SparkSession.getActiveSession()) is not None:
            _made(spark).extend(own)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names.

    Only in local mode, where that may be unset, a folder below the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` and read it back: later stages survive the loss of the executors that made it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: By how much a frame in memory may exceed what is estimated for one of many columns of its compressed files.
UNDERRATED = 1024


def _bytes(size: str) -> int:
    """Bytes of a size as settings name it."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, what a join broadcasts is bounded by its size in memory, not by its share of the files: all of it passes through the driver.

    Estimates may be an `UNDERRATED`th of the limit; beyond that a shuffle measures first, and what is small then is
    broadcast still. It is the session's setting that changes, for frames that are run inside.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    was = {k: spark.conf.get(k, None) for k in (planned, measured)}
    most = spark.conf.get(planned)
    spark.conf.set(measured, was[measured] or most)
    spark.conf.set(planned, _bytes(most) // UNDERRATED if _bytes(most) > 0 else most)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def mark(spark: SparkSession) -> int:
    """How many folders were made so far; for `clear`."""
    return len(_made(spark))


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the folders made since a mark, but for the last `keep` of them. Frames that read them are of no use then."""
    made = _made(spark)
    end = max(since, len(made) - keep)
    for path in made[since:end]:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    del made[since:end]
