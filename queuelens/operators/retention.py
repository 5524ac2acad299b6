"""Retention: what stays of each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.times import ago
from queuelens.schemas import TASK_TERMINAL, WORKFLOW_TERMINAL


def keep_recent(df: DataFrame, time: str, as_of: Column, keep: int) -> DataFrame:
    """Rows that are not older than `keep` seconds; on a table by day whole days are pruned."""
    kept = df.filter(~F.coalesce(F.col(time) < ago(as_of, keep), F.lit(False)))
    return kept.filter(F.col("day") >= F.to_date(ago(as_of, keep))) if "day" in df.columns else kept


def _age(df: DataFrame, *names: str) -> Column:
    return F.coalesce(*[F.col(n) for n in names if n in df.columns])


def old_workflows(workflows: DataFrame, as_of: Column, keep: int) -> DataFrame:
    ended = F.col("status").isin(*WORKFLOW_TERMINAL) & (_age(workflows, "completed_at", "updated_at", "created_at") < ago(as_of, keep))
    return workflows.filter(ended)


def keep_workflows(workflows: DataFrame, as_of: Column, keep: int) -> DataFrame:
    """Workflows that stay. Children of a deleted parent go with it."""
    gone = old_workflows(workflows, as_of, keep).select(F.col("id").alias("_gone"))
    kept = workflows.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    for _ in range(int(workflows.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0])):
        parents = kept.select(F.col("id").alias("_parent"))
        orphans = kept.filter("parent_workflow_id is not null").select(F.col("id").alias("_child"), F.col("parent_workflow_id").alias("_parent")).join(parents, "_parent", "left_anti").select("_child")
        kept = kept.join(orphans, F.col("id") == F.col("_child"), "left_anti")
    return kept


def keep_nodes(nodes: DataFrame, workflows: DataFrame, as_of: Column, keep: int) -> DataFrame:
    gone = old_workflows(workflows, as_of, keep).select(F.col("id").alias("workflow_id"))
    return nodes.join(gone, "workflow_id", "left_anti").select(nodes.columns)


def keep_tasks(tasks: DataFrame, nodes: DataFrame, workflows: DataFrame, as_of: Column, keep: int) -> DataFrame:
    """Tasks that stay: not ended, not old, or of a workflow that has not ended."""
    live = workflows.filter(~F.col("status").isin(*WORKFLOW_TERMINAL)).select(F.col("id").alias("workflow_id"))
    used = nodes.filter("task_id is not null").join(live, "workflow_id", "left_semi").select(F.col("task_id").alias("_used")).distinct()
    old = F.col("status").isin(*TASK_TERMINAL) & (_age(tasks, "completed_at", "failed_at", "updated_at", "created_at", "enqueued_at") < ago(as_of, keep))
    seen = tasks.join(used, F.col("id") == F.col("_used"), "left")
    return seen.filter(~F.coalesce(old, F.lit(False)) | F.col("_used").isNotNull()).drop("_used")


def keep_attempts(attempts: DataFrame, kept_tasks: DataFrame) -> DataFrame:
    """Attempts go with their task."""
    return attempts.join(kept_tasks.select(F.col("id").alias("task_id")), "task_id", "left_semi").select(attempts.columns)
