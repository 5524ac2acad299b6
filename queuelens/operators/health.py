"""Stale, expired and in-flight tasks; statistics of the workers that run them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.times import ago, seconds_between


def last_heartbeats(heartbeats: DataFrame, role: str) -> DataFrame:
    """(task_id, last_heartbeat) by one role ("runner" or "claimer"): one combined row per task."""
    return heartbeats.filter(F.col("role") == role).groupBy("task_id").agg(F.max("sent_at").alias("last_heartbeat"))


def with_heartbeat(tasks: DataFrame, heartbeats: DataFrame, role: str) -> DataFrame:
    return tasks.join(last_heartbeats(heartbeats, role), tasks.id == F.col("task_id"), "left").drop("task_id")


def is_stale_running(as_of: Column, threshold: int) -> Column:
    """RUNNING, and the last sign of life is older than the threshold in seconds."""
    sign = F.coalesce("last_heartbeat", "started_at")
    return (F.col("status") == "RUNNING") & F.col("started_at").isNotNull() & (sign < ago(as_of, threshold))


def is_stale_claimed(as_of: Column, threshold: int, claimed_at: str = "claimed_at") -> Column:
    sign = F.coalesce("last_heartbeat", claimed_at)
    return (F.col("status") == "CLAIMED") & (sign < ago(as_of, threshold))


def stale_tasks(tasks: DataFrame, heartbeats: DataFrame, as_of: Column, threshold: int = 300) -> DataFrame:
    """Running tasks without a recent heartbeat, those without any first."""
    running = tasks.filter("status = 'RUNNING' and started_at is not null")
    stale = with_heartbeat(running, heartbeats, "runner").filter(is_stale_running(as_of, threshold))
    columns = [c for c in ("id", "worker_hostname", "worker_pid", "worker_process_name", "last_heartbeat", "started_at", "task_name", "retry_count", "max_retries", "task_options", "good_until", "claimed_by_worker_id") if c in stale.columns]
    return stale.select(columns).orderBy(F.asc_nulls_first("last_heartbeat"), "id")


def worker_stats(tasks: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """Running tasks of each worker process, its oldest start and latest heartbeat."""
    running = tasks.filter("status = 'RUNNING' and worker_hostname is not null")
    keys = [c for c in ("worker_hostname", "worker_pid", "worker_process_name") if c in tasks.columns]
    return with_heartbeat(running, heartbeats, "runner").groupBy(*keys).agg(F.count("*").alias("active_tasks"), F.min("started_at").alias("oldest_task_start"), F.max("last_heartbeat").alias("latest_heartbeat")).orderBy(F.desc("active_tasks"), *keys)


def expired_tasks(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Pending tasks past their deadline, and for how long."""
    late = tasks.filter((F.col("status") == "PENDING") & (F.col("good_until") <= as_of))
    return late.select("id", "task_name", "queue_name", "priority", "enqueued_at", "good_until", seconds_between(F.col("good_until"), as_of).alias("expired_seconds")).orderBy("good_until", "id")


def stale_claimed(tasks: DataFrame, heartbeats: DataFrame, as_of: Column, threshold: int = 120, claimed_at: str = "claimed_at") -> DataFrame:
    """Claimed tasks whose claimer, or if it never reported the claim itself, is too old."""
    claimed = with_heartbeat(tasks.filter("status = 'CLAIMED'"), heartbeats, "claimer")
    return claimed.filter(is_stale_claimed(as_of, threshold, claimed_at)).select("id", "claimed_by_worker_id", "last_heartbeat")


def active_claim(as_of: Column) -> Column:
    """CLAIMED with a lease that is open or not over yet; others can be claimed anew."""
    return (F.col("status") == "CLAIMED") & (F.col("claim_expires_at").isNull() | (F.col("claim_expires_at") > as_of))


def in_flight(as_of: Column) -> Column:
    return (F.col("status") == "RUNNING") | active_claim(as_of)


def load_counts(tasks: DataFrame, as_of: Column, *by: str) -> DataFrame:
    """in_flight (hard cap), running (soft cap) and claimed tasks, in all or by queue or worker."""
    counts = [F.count_if(in_flight(as_of)).alias("in_flight"), F.count_if(F.col("status") == "RUNNING").alias("running"), F.count_if(active_claim(as_of)).alias("claimed")]
    live = tasks.filter(F.col("status").isin("RUNNING", "CLAIMED"))
    return (live.groupBy(*by) if by else live).agg(*counts)


def nonrunnable_tasks(tasks: DataFrame, nodes: DataFrame, workflows: DataFrame) -> DataFrame:
    """(id, workflow_status) of tasks whose workflow is paused or cancelled."""
    stopped = workflows.filter(F.col("status").isin("PAUSED", "CANCELLED")).select(F.col("id").alias("workflow_id"), F.col("status").alias("workflow_status"))
    linked = nodes.filter("task_id is not null").select("workflow_id", "task_id").join(stopped, "workflow_id")
    return tasks.select("id").join(linked, F.col("id") == F.col("task_id")).select("id", "workflow_status")
