"""Monitoring queries over tasks, workers and workflows.

Every function takes DataFrames and the instant `as_of` that stands for now,
and returns a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.functions.times import ago, duration_text, ratio, rounded, seconds_between
from queuelens.operators.latest import latest, one_of, top_counts, where
from queuelens.schemas import WORKFLOW_STATES

# ---- tasks -----------------------------------------------------------------


def _counted(tasks: DataFrame, retried_only: bool, statuses: list[str] | None) -> DataFrame:
    base = where(tasks, F.col("retry_count") > 0 if retried_only else None)
    if statuses is not None:
        base = base.filter(F.col("status").isin(*statuses)) if statuses else base.filter(F.lit(False))
    return base


def task_ids(tasks: DataFrame, retried_only: bool = False, statuses: list[str] | None = None) -> DataFrame:
    """(worker_id, id, retry_count, enqueued_at): the tasks that `task_breakdown` counts, a row each; for tables where a worker has too many for one row."""
    return _counted(tasks, retried_only, statuses).select(F.coalesce("claimed_by_worker_id", F.lit("unknown")).alias("worker_id"), "id", "retry_count", "enqueued_at")


def task_breakdown(tasks: DataFrame, retried_only: bool = False, statuses: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Counts by state for each worker, with a total row, and the worker's tasks in order.

    With `statuses` only tasks in one of them count; an empty list means no
    task. The ids are those of all counted tasks, whatever their state; with
    `most` the first so many of each worker, which tasks cut to before the
    shuffle (all of them in one row can be too many: see `task_ids`).
    """
    base = _counted(tasks, retried_only, statuses)
    states = {s: F.count_if(F.col("status") == s.upper()).alias(f"{s}_count") for s in ("pending", "claimed", "running", "completed", "failed", "cancelled", "expired")}
    numbers = [F.count("*").alias("total_count"), *states.values(), F.count_if(F.col("retry_count") > 0).alias("retried_count")]
    # A worker's tasks are gathered by worker alone: the total row holds no ids.
    rows = F.array_sort(F.collect_list(F.struct("enqueued_at", "id", "retry_count"))).alias("rows")
    if most is None:
        per_worker = base.groupBy("claimed_by_worker_id").agg(*numbers, rows)
    else:
        place = F.row_number().over(Window.partitionBy("claimed_by_worker_id").orderBy("enqueued_at", "id"))
        first = base.withColumn("place", place).filter(F.col("place") <= most).groupBy(F.col("claimed_by_worker_id").alias("_worker")).agg(rows)
        counts = base.groupBy("claimed_by_worker_id").agg(*numbers)
        per_worker = counts.join(first, F.col("claimed_by_worker_id").eqNullSafe(F.col("_worker")), "left").drop("_worker")
    per_worker = per_worker.select(
        F.lit(0).alias("g"), F.coalesce("claimed_by_worker_id", F.lit("unknown")).alias("worker_id"), *[c for c in per_worker.columns if c.endswith("_count")],
        F.transform("rows", lambda r: r.id).alias("claimed_task_ids"), F.transform("rows", lambda r: r.retry_count).alias("claimed_retry_counts"),
    )
    total = base.agg(*numbers).select(F.lit(1).alias("g"), F.lit("TOTAL").alias("worker_id"), "*", F.lit(None).cast("array<string>").alias("claimed_task_ids"), F.lit(None).cast("array<int>").alias("claimed_retry_counts"))
    out = per_worker.unionByName(total).withColumn("running_task_ids", F.lit(None).cast("array<string>")).withColumn("running_retry_counts", F.lit(None).cast("array<int>"))
    return out.orderBy("g", "worker_id").drop("g")


def _chosen(tasks: DataFrame, worker: str | None, statuses: list[str], retried_only: bool) -> DataFrame:
    return where(tasks, F.col("claimed_by_worker_id") == worker if worker is not None else None, one_of("status", statuses), F.col("retry_count") > 0 if retried_only else None)


def task_facets(tasks: DataFrame, worker: str | None = None, statuses: list[str] | tuple = (), retried_only: bool = False) -> DataFrame:
    """(kind, value, count) of the most frequent task names (30), queues (30) and error codes (20)."""
    base = _chosen(tasks, worker, list(statuses), retried_only)
    names, queues = top_counts(base, "task_name", "task_name", 30), top_counts(base, "queue_name", "queue", 30)
    return names.unionByName(queues).unionByName(top_counts(base.filter("error_code is not null"), "error_code", "error", 20))


def facet(facets: DataFrame, kind: str) -> DataFrame:
    """(value, count) of one kind of facet: task_name, queue or error."""
    return facets.filter(F.col("kind") == kind).select("value", "count")


def task_status_view(tasks: DataFrame) -> DataFrame:
    """Counts of seven fixed states and of all tasks, expired ones among these alone."""
    spark = tasks.sparkSession
    # The shown states, in order.
    shown = spark.createDataFrame([(s, i + 1) for i, s in enumerate(("pending", "claimed", "running", "completed", "failed", "cancelled", "requeued"))], "status string, sort_order int")
    counts = tasks.groupBy(F.lower("status").alias("status")).agg(F.count("*").alias("count"))
    rows = shown.join(counts, "status", "left").select("status", F.coalesce("count", F.lit(0).cast("long")).alias("count"), "sort_order")
    # The total is the sum over all states, so tasks are read once.
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("count")).select(F.lit("TOTAL").alias("status"), "count", F.lit(8).alias("sort_order"))
    return rows.unionByName(total).orderBy("sort_order")


def task_list(tasks: DataFrame, worker: str | None = None, statuses: tuple = (), retried_only: bool = False, names: tuple = (), queues: tuple = (), errors: tuple = (), limit: int = 500) -> DataFrame:
    """The latest tasks that pass all filters that are given."""
    base = where(_chosen(tasks, worker, list(statuses), retried_only), one_of("task_name", names), one_of("queue_name", queues), one_of("error_code", errors))
    columns = ["id", "task_name", "queue_name", "status", "error_code", "retry_count", "max_retries", "enqueued_at", "started_at", "completed_at", "failed_at"]
    return base.select(columns).orderBy(F.desc_nulls_first("enqueued_at"), "id").limit(limit)


def task_detail(tasks: DataFrame, task_id: str) -> DataFrame:
    return tasks.filter(F.col("id") == task_id)


def task_attempts(attempts: DataFrame, task_id: str) -> DataFrame:
    return attempts.filter(F.col("task_id") == task_id).orderBy(F.desc("attempt"))


def task_info(tasks: DataFrame, attempts: DataFrame, task_id: str) -> DataFrame:
    """A task with its attempts nested, latest first."""
    nested = attempts.filter(F.col("task_id") == task_id).groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("attempt", "outcome", "will_retry", "started_at", "finished_at")), asc=False).alias("attempts"))
    return task_detail(tasks, task_id).join(nested, F.col("id") == F.col("task_id"), "left").drop("task_id")


# ---- workers ---------------------------------------------------------------


def active_workers(states: DataFrame, as_of: Column, window: int = 120) -> DataFrame:
    """Latest snapshot of each worker seen within the window."""
    columns = ["worker_id", "hostname", "pid", "processes", "tasks_running", "tasks_claimed", "memory_percent", "cpu_percent", "snapshot_at"]
    recent = states.filter(F.col("snapshot_at") > ago(as_of, window))
    return latest(recent.select("id", *columns), "worker_id", "snapshot_at", "id").select(columns).orderBy("worker_id")


def cluster_capacity(states: DataFrame, as_of: Column) -> DataFrame:
    """Sums over the latest snapshots of active workers; the utilisation is a ratio of sums."""
    now = active_workers(states, as_of)
    return now.agg(
        F.count_distinct("worker_id").alias("active_workers"),
        F.sum("processes").alias("total_capacity"), F.sum("tasks_running").alias("total_running"), F.sum("tasks_claimed").alias("total_claimed"),
        rounded(ratio(F.sum("tasks_running") * F.lit(100.0), F.sum("processes")), 2).alias("cluster_utilization_pct"),
        rounded(F.avg("memory_percent"), 1).alias("avg_memory_pct"), rounded(F.avg("cpu_percent"), 1).alias("avg_cpu_pct"),
    )


def utilization_trend(states: DataFrame, as_of: Column, window: int = 3600) -> DataFrame:
    """By minute: mean of the snapshots' own ratios, and sums over all snapshots."""
    kind = states.schema["snapshot_at"].dataType
    minute = F.date_trunc("minute", "snapshot_at").cast(kind).alias("minute")
    recent = states.filter(F.col("snapshot_at") > ago(as_of, window))
    return recent.groupBy(minute).agg(
        rounded(F.avg(ratio(F.col("tasks_running"), F.col("processes"))) * 100, 2).alias("avg_utilization_pct"),
        F.sum("tasks_running").alias("total_running"), F.sum("processes").alias("total_capacity"),
    ).orderBy("minute")


def dead_workers(states: DataFrame, as_of: Column, window: int = 120) -> DataFrame:
    """Workers whose latest snapshot of all is older than the window."""
    last = latest(states.select("id", "worker_id", "hostname", "pid", "snapshot_at", "tasks_claimed"), "worker_id", "snapshot_at", "id")
    old = last.filter(F.col("snapshot_at") < ago(as_of, window))
    return old.select("worker_id", "hostname", "pid", F.col("snapshot_at").alias("last_seen"), seconds_between(F.col("snapshot_at"), as_of).alias("offline_seconds"), F.col("tasks_claimed").alias("tasks_at_death")).orderBy(F.desc("last_seen"), "worker_id")


def overloaded_workers(states: DataFrame, as_of: Column, window: int = 300, memory: float = 85, cpu: float = 80) -> DataFrame:
    """Latest overloaded snapshot of each worker, even if a newer one is healthy."""
    columns = ["worker_id", "hostname", "memory_percent", "cpu_percent", "tasks_running", "processes", "snapshot_at"]
    hot = states.filter((F.col("snapshot_at") > ago(as_of, window)) & ((F.col("memory_percent") > memory) | (F.col("cpu_percent") > cpu)))
    return latest(hot.select("id", *columns), "worker_id", "snapshot_at", "id").select(columns).orderBy("worker_id")


def snapshot_age(states: DataFrame, as_of: Column) -> DataFrame:
    """Snapshots and workers by age."""
    # Names and bounds of the classes.
    bounds = (("< 1 hour", 3600), ("1-24 hours", 24 * 3600), ("1-7 days", 7 * 24 * 3600), ("7-30 days", 30 * 24 * 3600))
    name, order = F.lit("> 30 days"), F.lit(len(bounds))
    for i, (label, n) in reversed(list(enumerate(bounds))):
        newer = F.col("snapshot_at") > ago(as_of, n)
        name, order = F.when(newer, label).otherwise(name), F.when(newer, i).otherwise(order)
    aged = states.select(name.alias("age_bucket"), order.alias("age_order"), "worker_id")
    counted = aged.groupBy("age_bucket", "age_order").agg(F.count("*").alias("snapshot_count"), F.count_distinct("worker_id").alias("unique_workers"))
    return counted.orderBy("age_order").drop("age_order")


def stale_claims(states: DataFrame, as_of: Column, window: int = 120) -> DataFrame:
    """Latest snapshot of each worker that has claimed more than twice what it runs."""
    much = states.filter((F.col("snapshot_at") > ago(as_of, window)) & (F.col("tasks_claimed") > F.col("tasks_running") * 2))
    last = latest(much.select("id", "worker_id", "hostname", "tasks_running", "tasks_claimed", "snapshot_at"), "worker_id", "snapshot_at", "id")
    claim_ratio = rounded(ratio(F.col("tasks_claimed"), F.col("tasks_running")), 2).alias("claim_ratio")
    return last.select("worker_id", "hostname", "tasks_running", "tasks_claimed", claim_ratio, "snapshot_at").orderBy("worker_id")


def worker_queues(states: DataFrame, as_of: Column, window: int = 120) -> DataFrame:
    """Queue settings in the latest snapshot of each active worker."""
    columns = [c for c in ("worker_id", "hostname", "queues", "queue_priorities", "queue_max_concurrency", "tasks_running", "tasks_claimed") if c in states.columns]
    recent = states.filter(F.col("snapshot_at") > ago(as_of, window))
    return latest(recent.select("id", "snapshot_at", *columns), "worker_id", "snapshot_at", "id").select(columns).orderBy("worker_id")


def worker_uptime(states: DataFrame, as_of: Column, window: int = 300) -> DataFrame:
    recent = states.filter(F.col("snapshot_at") > ago(as_of, window))
    last = latest(recent.select("id", "worker_id", "hostname", "worker_started_at", "snapshot_at"), "worker_id", "snapshot_at", "id")
    return last.select("worker_id", "hostname", "worker_started_at", F.col("snapshot_at").alias("last_seen"), seconds_between("worker_started_at", "snapshot_at").alias("uptime_seconds")).orderBy("worker_id")


#: The offered windows of the load history.
LOAD_WINDOWS = {"5m": 300, "30m": 1800, "1h": 3600, "6h": 6 * 3600, "24h": 24 * 3600}


def worker_load(states: DataFrame, as_of: Column, window: str = "1h", worker: str | None = None) -> DataFrame:
    """Snapshots within a window, of all workers or one."""
    recent = where(states, F.col("snapshot_at") > ago(as_of, LOAD_WINDOWS[window]), F.col("worker_id") == worker if worker is not None else None)
    return recent.select("worker_id", "snapshot_at", "tasks_running", "tasks_claimed", "memory_percent", "cpu_percent").orderBy("worker_id", "snapshot_at")


def load_scale(states: DataFrame, as_of: Column, window: str = "1h") -> DataFrame:
    """Largest load of each worker within a window, as charts scale by it."""
    return worker_load(states, as_of, window).groupBy("worker_id").agg(F.max("tasks_running").alias("max_running"), F.max("tasks_claimed").alias("max_claimed"))


# ---- workflows -------------------------------------------------------------


def node_counts(nodes: DataFrame) -> DataFrame:
    """Nodes of each workflow by state."""
    state = F.col("status")
    return nodes.groupBy("workflow_id").agg(
        F.count("id").alias("total_tasks"),
        F.count_if(state == "COMPLETED").alias("completed_tasks"), F.count_if(state == "FAILED").alias("failed_tasks"), F.count_if(state == "RUNNING").alias("running_tasks"),
        F.count_if(state.isin("PENDING", "READY")).alias("pending_tasks"), F.count_if(state == "ENQUEUED").alias("enqueued_tasks"), F.count_if(state == "SKIPPED").alias("skipped_tasks"),
    )


def with_counts(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Workflows with the counts of their nodes, 0 where they have none."""
    counts = node_counts(nodes)
    names = [c for c in counts.columns if c != "workflow_id"]
    return workflows.join(counts, workflows.id == counts.workflow_id, "left").select(workflows["*"], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names])


def workflow_list(workflows: DataFrame, nodes: DataFrame, statuses: list[str] | None = None, limit: int = 100) -> DataFrame:
    """The latest workflows with counts of their nodes; statuses=[] means none.

    The limit comes first: the nodes of other workflows are never aggregated.
    """
    if statuses is not None:
        workflows = workflows.filter(F.col("status").isin(*statuses)) if statuses else workflows.filter(F.lit(False))
    shown = workflows.orderBy(F.desc_nulls_first("created_at"), "id").limit(limit)
    theirs = nodes.join(F.broadcast(shown.select(F.col("id").alias("workflow_id"))), "workflow_id", "left_semi")
    return with_counts(shown, theirs).orderBy(F.desc_nulls_first("created_at"), "id")


def workflow_by_id(workflows: DataFrame, nodes: DataFrame, workflow_id: str) -> DataFrame:
    return with_counts(workflows.filter(F.col("id") == workflow_id), nodes.filter(F.col("workflow_id") == workflow_id))


def workflow_detail(nodes: DataFrame, workflow_id: str) -> DataFrame:
    return nodes.filter(F.col("workflow_id") == workflow_id).orderBy("task_index")


def workflow_summary(workflows: DataFrame) -> DataFrame:
    states = ("pending", "running", "completed", "failed", "paused", "cancelled")
    return workflows.agg(*[F.count_if(F.col("status") == s.upper()).alias(s) for s in states])


def workflow_totals(workflows: DataFrame) -> DataFrame:
    """One row: all workflows, and how many are in each state."""
    return workflows.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in WORKFLOW_STATES])


def workflow_progress(workflows: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """Finished and successful shares of each workflow's nodes, and how long it runs or ran."""
    counted = with_counts(workflows, nodes)
    done = F.col("completed_tasks") + F.col("failed_tasks") + F.col("skipped_tasks")
    share = lambda part, whole: F.when(whole > 0, part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))).otherwise(0.0)
    secs = seconds_between(F.col("created_at"), F.coalesce("completed_at", as_of))
    return counted.select(
        "id", "name", "status", "total_tasks", done.alias("terminal_tasks"), share(done, F.col("total_tasks")).alias("progress"), share(F.col("completed_tasks"), done).alias("success_rate"),
        duration_text(secs).alias("duration"),
    )


# ---- search ----------------------------------------------------------------


def _holds(query: str, *columns: str) -> Column:
    """Whether one of the columns holds the text, in either case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c).cast("string")).contains(query.lower()), F.lit(False))
    return found


def search_workers(states: DataFrame, as_of: Column, query: str) -> DataFrame:
    """Active workers whose name, host or state (Running, Idle) holds the text."""
    now = active_workers(states, as_of).withColumn("state", F.when(F.col("tasks_running") > 0, "Running").otherwise("Idle"))
    return now.filter(_holds(query, "worker_id", "hostname", "state")).select("worker_id", "hostname", "state")


def search_tasks(tasks: DataFrame, query: str) -> DataFrame:
    """Tasks whose id, or whose worker's name, holds the text."""
    return tasks.withColumn("worker_id", F.coalesce("claimed_by_worker_id", F.lit("unknown"))).filter(_holds(query, "id", "worker_id")).select("worker_id", "id")


def search_workflows(workflows: DataFrame, query: str) -> DataFrame:
    return workflows.filter(_holds(query, "id", "name", "status")).select("id", "name", "status")


def search_alerts(states: DataFrame, as_of: Column, query: str) -> DataFrame:
    """Overloaded, dead and over-claiming workers whose name, host or kind of alert holds the text."""
    kinds = (("overloaded", overloaded_workers(states, as_of)), ("dead", dead_workers(states, as_of)), ("stale claims", stale_claims(states, as_of)))
    rows = [df.select(F.lit(kind).alias("alert"), "worker_id", "hostname") for kind, df in kinds]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).filter(_holds(query, "alert", "worker_id", "hostname"))
