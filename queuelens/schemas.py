"""Schemas, states and defaults of the seven tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The states of tasks, attempts, workflows and nodes.
TASK_STATES = ("PENDING", "CLAIMED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "EXPIRED")
TASK_TERMINAL = ("COMPLETED", "FAILED", "CANCELLED", "EXPIRED")
ATTEMPT_OUTCOMES = ("COMPLETED", "FAILED", "WORKER_FAILURE")
WORKFLOW_STATES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "PAUSED", "CANCELLED")
WORKFLOW_TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
NODE_STATES = ("PENDING", "READY", "ENQUEUED", "RUNNING", "COMPLETED", "FAILED", "SKIPPED")
NODE_TERMINAL = ("COMPLETED", "FAILED", "SKIPPED")
JOIN_TYPES = ("all", "any", "quorum")
ON_ERROR = ("fail", "pause")

# Thresholds in seconds.
CLAIM_LEASE, MAX_CLAIM_AGE = 60, 180
STALE_CLAIMED, STALE_RUNNING = 120, 300
KEEP_HEARTBEATS, KEEP_SNAPSHOTS, KEEP_TERMINAL = 24 * 3600, 7 * 24 * 3600, 30 * 24 * 3600


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()), "map<string,int>": T.MapType(T.StringType(), T.IntegerType()),
}


def _schema(text: str) -> T.StructType:
    """A schema from "name type" pairs; needs no session."""
    return T.StructType([T.StructField(*pair.split(" ")[:1], _TYPES[pair.split(" ")[1]]) for pair in text.split(", ")])


TASKS = _schema(
    "id string, task_name string, queue_name string, priority int, args string, kwargs string, status string, sent_at timestamp, enqueued_at timestamp, "
    "claimed_at timestamp, started_at timestamp, completed_at timestamp, failed_at timestamp, result string, failed_reason string, error_code string, claimed boolean, "
    "claimed_by_worker_id string, claim_expires_at timestamp, good_until timestamp, retry_count int, max_retries int, next_retry_at timestamp, task_options string, "
    "enqueue_sha string, worker_pid int, worker_hostname string, worker_process_name string, created_at timestamp, updated_at timestamp"
)
TASK_ATTEMPTS = _schema(
    "id bigint, task_id string, attempt int, outcome string, will_retry boolean, started_at timestamp, finished_at timestamp, error_code string, error_message string, "
    "failed_reason string, worker_id string, worker_hostname string, worker_pid int, worker_process_name string, created_at timestamp"
)
HEARTBEATS = _schema("id int, task_id string, sender_id string, role string, sent_at timestamp, hostname string, pid int")
WORKER_STATES = _schema(
    "id int, worker_id string, snapshot_at timestamp, hostname string, pid int, processes int, max_claim_batch int, max_claim_per_worker int, cluster_wide_cap int, queues array<string>, "
    "queue_priorities map<string,int>, queue_max_concurrency map<string,int>, recovery_config string, tasks_running int, tasks_claimed int, memory_usage_mb double, memory_percent double, "
    "cpu_percent double, worker_started_at timestamp"
)
SCHEDULE_STATE = _schema("schedule_name string, last_run_at timestamp, next_run_at timestamp, last_task_id string, run_count int, config_hash string, updated_at timestamp")
WORKFLOWS = _schema(
    "id string, name string, status string, on_error string, output_task_index int, success_policy string, result string, error string, definition_key string, parent_workflow_id string, "
    "parent_task_index int, depth int, root_workflow_id string, sent_at timestamp, created_at timestamp, started_at timestamp, completed_at timestamp, updated_at timestamp"
)
WORKFLOW_TASKS = _schema(
    "id string, workflow_id string, task_index int, node_id string, task_name string, task_args string, task_kwargs string, queue_name string, priority int, dependencies array<int>, "
    "args_from map<string,int>, workflow_ctx_from array<string>, allow_failed_deps boolean, join_type string, min_success int, task_options string, status string, task_id string, "
    "is_subworkflow boolean, sub_workflow_id string, sub_workflow_name string, sub_definition_key string, sub_workflow_summary string, result string, error string, created_at timestamp, "
    "started_at timestamp, completed_at timestamp"
)
POLICY = "struct<cases: array<struct<required_indices: array<int>>>, optional_indices: array<int>>"


def complete(df: DataFrame, schema: T.StructType, instant: T.DataType | None = None) -> DataFrame:
    """`df` with the columns of `schema` that it lacks as typed nulls.

    `instant` overrides the type of timestamps, for tables without time zones.
    """
    kind = lambda f: instant if instant is not None and isinstance(f.dataType, T.TimestampType) else f.dataType
    return df.withColumns({f.name: F.lit(None).cast(kind(f)) for f in schema if f.name not in df.columns})


def upgrade_tasks(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Tasks written before enqueue times and fingerprints existed, brought to the present schema."""
    tasks = complete(tasks, T.StructType([f for f in TASKS if f.name in ("sent_at", "enqueued_at", "enqueue_sha")]))
    return tasks.withColumns({"enqueued_at": F.coalesce("enqueued_at", "sent_at", as_of), "enqueue_sha": F.coalesce("enqueue_sha", F.lit("legacy-pre-sha"))})


def upgrade_attempts(attempts: DataFrame | None, tasks: DataFrame, as_of: Column) -> DataFrame:
    """The table of attempts at the present schema; None is a database from before it existed.

    Past attempts can't be told from a task, so that such a database starts
    with an empty table. Rows of an older table get the columns that it lacks:
    `will_retry` is false, and `created_at` the instant of their end.
    """
    kinds = {f.name: tasks.schema["enqueued_at"].dataType for f in TASK_ATTEMPTS if isinstance(f.dataType, T.TimestampType)}
    if attempts is None:
        empty = tasks.limit(0)
        return empty.select(*[F.lit(None).cast(kinds.get(f.name, f.dataType)).alias(f.name) for f in TASK_ATTEMPTS])
    whole = attempts.withColumns({f.name: F.lit(None).cast(kinds.get(f.name, f.dataType)) for f in TASK_ATTEMPTS if f.name not in attempts.columns})
    ended = F.coalesce("created_at", "finished_at", as_of).cast(whole.schema["created_at"].dataType)
    return whole.withColumns({"will_retry": F.coalesce("will_retry", F.lit(False)), "created_at": ended}).select([f.name for f in TASK_ATTEMPTS])


def upgrade_workflows(workflows: DataFrame, as_of: Column) -> DataFrame:
    """Workflows written before `sent_at` existed."""
    workflows = complete(workflows, T.StructType([WORKFLOWS["sent_at"]]))
    return workflows.withColumn("sent_at", F.coalesce("sent_at", "created_at", as_of))


def invalid(tasks: DataFrame) -> DataFrame:
    """Task rows that break a constraint, with what they break."""
    rules = {
        "status": ~F.col("status").isin(*TASK_STATES),
        "priority": ~F.col("priority").between(1, 100),
        "retry_count": F.col("retry_count") < 0,
        "id": F.col("id").isNull(),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return tasks.withColumn("broken", broken).filter(F.size("broken") > 0)
