"""Structured Streaming forms of the time-driven queries.

Event-time columns must be timestamps with time zone; `zoned` turns the
fixtures' into such. Watermarks are an extension: by default they are as long
as the retention, so that no row is dropped that a batch query would keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.times import ratio, rounded

DELAY = "7 days"


def zoned(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def trend(states: DataFrame, delay: str = DELAY) -> DataFrame:
    """Utilisation by minute, as `monitor.utilization_trend` without its window."""
    minute = F.window("snapshot_at", "1 minute")
    summed = states.withWatermark("snapshot_at", delay).groupBy(minute).agg(
        rounded(F.avg(ratio(F.col("tasks_running"), F.col("processes"))) * 100, 2).alias("avg_utilization_pct"),
        F.sum("tasks_running").alias("total_running"), F.sum("processes").alias("total_capacity"),
    )
    return summed.select(F.col("window.start").alias("minute"), "avg_utilization_pct", "total_running", "total_capacity")


def latest_worker(states: DataFrame) -> DataFrame:
    """Latest snapshot of each worker, for update or complete mode; the state holds one row per worker."""
    row = F.max_by(F.struct("hostname", "tasks_running", "tasks_claimed", "snapshot_at"), F.struct("snapshot_at", "id")).alias("row")
    return states.groupBy("worker_id").agg(row).select("worker_id", "row.*")


def deduplicated(events: DataFrame, key: str, time: str, delay: str = DELAY) -> DataFrame:
    """Each key once within the watermark, as enqueueing the same id again has no effect."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def change_feed(tasks: DataFrame, time: str = "enqueued_at", delay: str = DELAY) -> DataFrame:
    """(channel, payload, at) messages of a stream of task rows, for each task and state once.

    Every state goes to task_status; pending tasks go to all workers and to
    those of their queue, ended ones to whom waits for them.
    """
    pending = F.col("status") == "PENDING"
    channels = F.array(F.lit("task_status"), F.when(pending, "task_new"), F.when(pending, F.concat(F.lit("task_queue_"), F.col("queue_name"))), F.when(F.col("status").isin("COMPLETED", "FAILED", "CANCELLED", "EXPIRED"), "task_done"))
    once = tasks.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id", "status"])
    return once.select(F.explode(F.array_compact(channels)).alias("channel"), F.col("id").alias("payload"), F.col(time).alias("at"))


def row_feed(rows: DataFrame, channel: str, key: str, time: str) -> DataFrame:
    """(channel, payload, at) messages, one for each row of a stream that only grows."""
    return rows.select(F.lit(channel).alias("channel"), F.col(key).alias("payload"), F.col(time).alias("at"))


def reaper(ticks: DataFrame, tasks: DataFrame, heartbeats: DataFrame, step: Callable[[DataFrame, DataFrame, Column], DataFrame], root: str, checkpoint: str) -> str:
    """Run the reaper for each micro-batch of `ticks` (at) over the tasks as the batch before left them.

    Each round's tasks are written below `root` by number of the batch, so
    that a batch which is run again after a failure gives the same table.
    Returns the folder of the last round; it is an error if no tick came.
    """
    spark, rounds = tasks.sparkSession, []

    def one(batch: DataFrame, number: int) -> None:
        as_of = batch.agg(F.max("at").alias("at")).first().at
        before = tasks if number == 0 else spark.read.schema(tasks.schema).parquet(f"{root}/round-{number - 1}")
        step(before, heartbeats, F.lit(as_of).cast("timestamp_ntz")).select(tasks.columns).write.mode("overwrite").parquet(f"{root}/round-{number}")
        rounds.append(number)

    ticks.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
    if not rounds:
        raise ValueError("there was no tick")
    return f"{root}/round-{max(rounds)}"


def drain(df: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over all that is available, and read what it wrote.

    In append mode rows go to Parquet files; in complete mode each micro-batch
    writes a folder of its own and the last one, which holds the whole result,
    is read.
    """
    spark = df.sparkSession
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        last = [0]

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch-{number}")
            last.append(number)

        query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    out = out if mode == "append" else f"{out}/batch-{max(last)}"
    return spark.read.schema(df.schema).parquet(out)
