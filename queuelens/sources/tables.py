"""The seven tables as one typed value, read from Parquet, a database, or the fixtures."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens import schemas
from queuelens.sources import fixtures


@dataclass(frozen=True)
class Tables:
    tasks: DataFrame
    task_attempts: DataFrame
    heartbeats: DataFrame
    worker_states: DataFrame
    schedule_state: DataFrame
    workflows: DataFrame
    workflow_tasks: DataFrame
    as_of: Column
    #: Where the tables are from, if they are fixtures.
    path: str = ""


def completed(t: Tables) -> Tables:
    """The tables with all columns of their schemas; those that they lack are null, instants without a time zone.

    Transitions write columns that a table may not have been read with.
    """
    kinds = {"tasks": schemas.TASKS, "task_attempts": schemas.TASK_ATTEMPTS, "heartbeats": schemas.HEARTBEATS, "worker_states": schemas.WORKER_STATES, "schedule_state": schemas.SCHEDULE_STATE, "workflows": schemas.WORKFLOWS, "workflow_tasks": schemas.WORKFLOW_TASKS}
    return replace(t, **{n: schemas.complete(getattr(t, n), s, T.TimestampNTZType()) for n, s in kinds.items()})


NAMES = tuple(f.name for f in fields(Tables) if f.name not in ("as_of", "path"))


def from_fixtures(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(**{n: fixtures.table(spark, sf_dir, n) for n in NAMES}, as_of=F.expr(f"TIMESTAMP_NTZ '{fixtures.AS_OF}'"), path=sf_dir)


def from_parquet(spark: SparkSession, path: str, as_of: Column) -> Tables:
    return Tables(**{n: spark.read.parquet(f"{path}/{n}") for n in NAMES}, as_of=as_of)


def from_jdbc(spark: SparkSession, url: str, as_of: Column, prefix: str = "", partitions: int = 8, **options: str) -> Tables:
    """Read the tables from a database; heartbeats and snapshots in parallel, by id."""

    def read(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=f"{prefix}{name}", **options)
        if name in ("heartbeats", "worker_states"):
            top = spark.read.format("jdbc").options(url=url, query=f'select min("id") as "lo", max("id") as "hi" from {prefix}{name}', **options).load().first()
            if top.lo is not None:
                reader = reader.options(partitionColumn="id", lowerBound=top.lo, upperBound=top.hi + 1, numPartitions=partitions)
        return reader.load()

    return Tables(**{n: read(n) for n in NAMES}, as_of=as_of)


def write(tables: Tables, path: str) -> None:
    """Write all tables as Parquet; time series by day, so that windows and retention prune."""
    days = {"heartbeats": "sent_at", "worker_states": "snapshot_at"}
    for n in NAMES:
        df: DataFrame = getattr(tables, n)
        if n in days:
            df.withColumn("day", F.to_date(days[n])).write.mode("overwrite").partitionBy("day").parquet(f"{path}/{n}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{n}")
