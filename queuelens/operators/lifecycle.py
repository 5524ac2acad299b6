"""Updates that follow from verdicts: retries, completions, recovery, resumption, starts.

Each function returns the next state of the tables it is given; `changed`
flags the rows that it moved, where one table is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions import results, tagged
from queuelens.functions.retry import OPTIONS, retry_plan
from queuelens.operators import dag, transitions
from queuelens.operators.health import is_stale_running, with_heartbeat
from queuelens.operators.transitions import RELEASED, update
from queuelens.sources.shared import written

# ---- retries ---------------------------------------------------------------


def _retried(tasks: DataFrame, plan: DataFrame) -> tuple[DataFrame, Column]:
    """Tasks with `_at`, the instant of their retry, and whether it may be scheduled: only before the deadline."""
    at = plan.groupBy(F.col("id").alias("_id")).agg(F.max("retry_at").alias("_at"))
    seen = tasks.join(at, F.col("id") == F.col("_id"), "left").drop("_id")
    return seen, (F.col("status") == "RUNNING") & F.col("_at").isNotNull() & (F.col("good_until").isNull() | (F.col("_at") < F.col("good_until")))


def _again(as_of: Column) -> dict[str, Column]:
    return {"status": F.lit("PENDING"), "retry_count": F.col("retry_count") + 1, "next_retry_at": F.col("_at"), "enqueued_at": F.col("_at"), "error_code": F.lit(None), "updated_at": as_of}


def schedule_retries(tasks: DataFrame, plan: DataFrame, as_of: Column) -> DataFrame:
    """Running tasks with a `retry_at` in `plan` (id, retry_at) wait for their next attempt."""
    seen, guard = _retried(tasks, plan)
    return update(seen, guard, _again(as_of)).drop("_at")


def schedule_stale_retries(tasks: DataFrame, heartbeats: DataFrame, plan: DataFrame, as_of: Column, threshold: int = 300) -> DataFrame:
    """The same for tasks whose runner is silent; they lose their claim as well."""
    seen, guard = _retried(with_heartbeat(tasks, heartbeats, "runner"), plan)
    return update(seen, guard & is_stale_running(as_of, threshold), {**RELEASED(as_of), **_again(as_of)}).drop("_at", "last_heartbeat")


def settle_stale(tasks: DataFrame, heartbeats: DataFrame, as_of: Column, threshold: int = 300) -> DataFrame:
    """Silent running tasks: those whose policy names WORKER_CRASHED are tried again, the others fail."""
    plan = retry_plan(tasks.filter("status = 'RUNNING'"), as_of, F.from_json("task_options", OPTIONS), F.lit("WORKER_CRASHED")).filter("verdict = 'scheduled'")
    again = schedule_stale_retries(tasks, heartbeats, plan, as_of, threshold).withColumnRenamed("changed", "_again")
    both = transitions.mark_stale_failed(again, heartbeats, as_of, threshold)
    return both.withColumn("changed", F.col("changed") | F.col("_again")).drop("_again")


def stale_attempts(tasks: DataFrame, heartbeats: DataFrame, as_of: Column, threshold: int = 300) -> DataFrame:
    """The attempt rows that `settle_stale` leaves: failed ones, with `will_retry` where the task is tried again."""
    stale = with_heartbeat(tasks, heartbeats, "runner").filter(is_stale_running(as_of, threshold))
    planned = retry_plan(stale, as_of, F.from_json("task_options", OPTIONS), F.lit(results.CRASHED))
    reason = F.lit(transitions.stale_reason(threshold))
    own = [F.col(c) if c in tasks.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("worker_hostname", "string"), ("worker_pid", "int"), ("worker_process_name", "string"))]
    return planned.select(
        F.col("id").alias("task_id"), (F.col("retry_count") + 1).alias("attempt"), F.lit("FAILED").alias("outcome"), (F.col("verdict") == "scheduled").alias("will_retry"), "started_at", as_of.alias("finished_at"),
        F.lit(results.CRASHED).alias("error_code"), reason.alias("error_message"), reason.alias("failed_reason"), F.col("claimed_by_worker_id").alias("worker_id"), *own,
    )


def finalize_or_retry(tasks: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Running tasks end as `outcomes` say; those that failed and may be tried again wait for it instead."""
    again = schedule_retries(tasks, outcome_plan(tasks, outcomes, as_of), as_of).withColumnRenamed("changed", "_again")
    ended = transitions.finalize(again, outcomes, as_of)
    return ended.withColumn("changed", F.col("changed") | F.col("_again")).drop("_again")


def outcome_plan(tasks: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """(id, verdict, retry_at) of running tasks whose outcome is a failure of their own; losses of the worker aren't tried again."""
    failed = outcomes.filter("not ok and result is not null").groupBy(F.col("task_id").alias("id")).agg(F.min("error_code").alias("_code"))
    running = tasks.filter("status = 'RUNNING'").join(failed, "id")
    return retry_plan(running, as_of, F.from_json("task_options", OPTIONS), F.col("_code")).filter("verdict = 'scheduled'").select("id", "verdict", "retry_at")


# ---- completions -----------------------------------------------------------


def failure_errors(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, error) of each workflow, should it fail: that of its first failed node; with a policy that of the first failed
    required one, else that no case is met. Results that can't be read give none; a policy that can't be read gives none either."""
    of = lambda df, name: df.select(F.col("workflow_id").alias("id"), F.expr(results.error_of("result")).alias(name))
    seen = workflows.select("id", "success_policy").join(of(dag.first_failed(nodes), "_first"), "id", "left").join(of(dag.first_failed(nodes, workflows), "_required"), "id", "left")
    readable = F.expr(results.is_object("success_policy"))
    return seen.select("id", F.when(F.col("success_policy").isNull(), F.col("_first")).when(readable, F.coalesce("_required", F.expr(results.case_not_met()))).alias("error"))


def apply_completions(workflows: DataFrame, nodes: DataFrame, as_of: Column, keep_error: bool = False) -> DataFrame:
    """Running workflows whose nodes have all ended are COMPLETED or FAILED, with their result and error.

    One aggregate over the nodes finds them; only their nodes are read further.
    With `keep_error` an error that is noted already stays.
    """
    over = written(dag.completion_status(workflows.filter("status = 'RUNNING' and completed_at is null"), nodes).filter("incomplete = 0").select("id"), "lifecycle-over")
    flows = workflows.join(over, "id", "left_semi")
    # They are read six times, so they are taken out once.
    own = written(nodes.select("workflow_id", "task_index", "node_id", "dependencies", "status", "result").join(over.select(F.col("id").alias("workflow_id")), "workflow_id", "left_semi"), "lifecycle-own")
    ok = dag.success(flows, own).select(F.col("id").alias("_id"), F.when(F.col("succeeded"), "COMPLETED").otherwise("FAILED").alias("_to"))
    result = dag.final_results(flows, own).select(F.col("id").alias("_id"), F.col("result").alias("_result"))
    error = failure_errors(flows, own).select(F.col("id").alias("_id"), F.col("error").alias("_error"))
    # A workflow without nodes has no sinks: its value is an empty object.
    empty = F.lit(f'{{"{tagged.RESULT}":true,"ok":{{}},"err":null}}')
    verdict = ok.join(result, "_id", "left").join(error, "_id", "left").withColumn("_result", F.coalesce("_result", empty))
    seen = workflows.join(verdict, F.col("id") == F.col("_id"), "left")
    noted = F.coalesce("error", "_error") if keep_error else F.coalesce("_error", "error")
    changes = {
        "status": F.col("_to"), "result": F.col("_result"), "completed_at": as_of, "updated_at": as_of,
        "error": F.when(F.col("_to") == "FAILED", noted).otherwise(F.col("error")),
    }
    return update(seen, F.col("_to").isNotNull() & F.col("completed_at").isNull(), changes).drop("_id", "_to", "_result", "_error")


def apply_on_error(workflows: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """Running workflows with a failed node note its error, and pause if they are told so."""
    found = dag.on_error(workflows, nodes).select(F.col("id").alias("_id"), F.col("to").alias("_to"), F.col("error").alias("_error"))
    seen = workflows.join(found, F.col("id") == F.col("_id"), "left")
    guard = F.col("_id").isNotNull() & (F.col("status") == "RUNNING")
    return update(seen, guard, {"status": F.col("_to"), "error": F.col("_error"), "updated_at": as_of}).drop("_id", "_to", "_error")


def nodes_of_tasks(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(workflow_id, task_index, to, outcome) of the nodes whose tasks have an outcome (task_id, ok, result)."""
    linked = nodes.filter("task_id is not null").select("workflow_id", "task_index", "task_id")
    return linked.join(outcomes, "task_id").select("workflow_id", "task_index", F.when(F.col("ok"), "COMPLETED").otherwise("FAILED").alias("to"), F.col("result").alias("outcome"))


# ---- recovery and resumption -----------------------------------------------


def crashed_results(nodes: DataFrame, tasks: DataFrame, workflows: DataFrame) -> DataFrame:
    """(workflow_id, task_index, to, outcome) for open nodes whose task has ended.

    The task's result counts if it can be read; else an error says what happened.
    """
    given = tasks.select(F.col("id").alias("task_id"), F.col("result").alias("_given"))
    found = dag.rec_crashed(nodes, tasks, workflows).join(given, "task_id", "left").withColumn("_result", F.expr(results.canonical("_given")))
    # Error codes and messages by state of the task.
    code = "case when _given is not null then 'WORKER_CRASHED' when task_status = 'CANCELLED' then 'TASK_CANCELLED' when task_status = 'EXPIRED' then 'TASK_EXPIRED' when task_status = 'COMPLETED' then 'RESULT_NOT_AVAILABLE' else 'WORKER_CRASHED' end"
    message = (
        "case when _given is not null then 'Stored task result is corrupt and could not be deserialized' when task_status = 'CANCELLED' then 'Task was cancelled before producing a result' "
        "when task_status = 'EXPIRED' then 'Task expired before execution started (good_until passed)' when task_status = 'COMPLETED' then 'Task completed but result is missing' "
        "else concat('Worker crashed during task execution (task_status=', task_status, ', no result stored)') end"
    )
    data = results.obj(task_id=results.text("task_id"), task_status=results.text("task_status"), recovery="'\"case_1_7\"'")
    made = F.expr(results.failed(results.error(code, message, data)))
    fine = F.col("_result").isNotNull() & F.expr(results.member("_result", ".err")).isNull()
    return found.select("workflow_id", "task_index", F.when(fine, "COMPLETED").otherwise("FAILED").alias("to"), F.coalesce("_result", made).alias("outcome"))


def reap(tasks: DataFrame, heartbeats: DataFrame, as_of: Column, claimed: int = 120, running: int = 300) -> DataFrame:
    """One round of the reaper over the tasks: deadlines, silent claimers, silent runners."""
    out = transitions.expire_pending(tasks, as_of).withColumnRenamed("changed", "_a")
    out = transitions.requeue_claimed(out, heartbeats, as_of, claimed).withColumnRenamed("changed", "_b")
    out = settle_stale(out, heartbeats, as_of, running)
    return out.withColumn("changed", F.col("changed") | F.col("_a") | F.col("_b")).drop("_a", "_b")


# ---- starts and inserts ----------------------------------------------------


def start_nodes(nodes: DataFrame, started: DataFrame, workflows: DataFrame, as_of: Column) -> DataFrame:
    """ENQUEUED nodes of running workflows whose task (id) has started are RUNNING."""
    tasks = started.select(F.col("id").alias("task_id"), F.lit(True).alias("_started")).distinct()
    live = workflows.filter("status = 'RUNNING'").select(F.col("id").alias("workflow_id"), F.lit(True).alias("_live"))
    seen = nodes.join(tasks, "task_id", "left").join(live, "workflow_id", "left")
    return update(seen, (F.col("status") == "ENQUEUED") & F.col("_started") & F.col("_live"), {"status": F.lit("RUNNING"), "started_at": as_of}).select(*nodes.columns, "changed")


def guard_nodes(nodes: DataFrame, tasks: DataFrame, workflows: DataFrame, as_of: Column) -> DataFrame:
    """Nodes of claimed tasks whose workflow is stopped: of paused ones they wait again, of cancelled ones they are skipped."""
    claimed = tasks.filter("status = 'CLAIMED'").select(F.col("id").alias("task_id"), F.lit(True).alias("_claimed"))
    stopped = workflows.filter(F.col("status").isin("PAUSED", "CANCELLED")).select(F.col("id").alias("workflow_id"), F.col("status").alias("_stop"))
    seen = nodes.join(claimed, "task_id", "left").join(stopped, "workflow_id", "left").withColumn("_held", F.coalesce("_claimed", F.lit(False)))
    skipped = transitions.skip_nodes(seen, F.col("_held") & (F.col("_stop") == "CANCELLED"), as_of).withColumnRenamed("changed", "_skipped")
    out = transitions.reset_nodes(skipped, F.col("_held") & (F.col("_stop") == "PAUSED"))
    return out.withColumn("changed", F.col("changed") | F.col("_skipped")).select(*nodes.columns, "changed")


def link_children(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """Nodes whose child workflow (id, parent_workflow_id, parent_task_index) has started are RUNNING and know it."""
    made = children.select(F.col("id").alias("_child"), F.col("parent_workflow_id").alias("workflow_id"), F.col("parent_task_index").alias("task_index"))
    seen = nodes.join(made, ["workflow_id", "task_index"], "left")
    return update(seen, F.col("_child").isNotNull(), {"status": F.lit("RUNNING"), "sub_workflow_id": F.col("_child")}).select(*nodes.columns, "changed")


def insert(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The table with rows whose key it lacks; known keys keep their row. Repeated new keys count once."""
    once = new.dropDuplicates([key]).join(table.select(key), key, "left_anti")
    return table.unionByName(once, allowMissingColumns=True).select(table.columns)


def expand(children: DataFrame, definitions: DataFrame, as_of: Column) -> DataFrame:
    """Nodes of new child workflows (id, name), by the definition of their name (name, task_index, node_id, dependencies, ...)."""
    nodes = children.select(F.col("id").alias("workflow_id"), "name").join(definitions, "name").drop("name")
    return transitions.start_workflow(nodes.withColumn("id", F.concat_ws("/", "workflow_id", F.col("task_index").cast("string"))), as_of)


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A table of heartbeats or snapshots with new rows; columns that these lack are null, others than the table's are left out."""
    known = [c for c in rows.columns if c in table.columns]
    return table.unionByName(rows.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in known]), allowMissingColumns=True)


def of_workflows(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): the tasks that belong to a node; whoever waits for one asks its workflow too."""
    return tasks.select("id").join(nodes.select(F.col("task_id").alias("id")), "id", "left_semi")


# ---- lookups ---------------------------------------------------------------


def node_results(nodes: DataFrame, node_id: str | None = None) -> DataFrame:
    """(workflow_id, node_id, result) of nodes with a result, of all or of one node id."""
    found = nodes.filter("result is not null and node_id is not null")
    return (found if node_id is None else found.filter(F.col("node_id") == node_id)).select("workflow_id", "node_id", "result")


def summaries(nodes: DataFrame) -> DataFrame:
    """(workflow_id, task_index, summaries): by node id, of the sub-workflow nodes that a node asks to see."""
    wanted = nodes.select("workflow_id", "task_index", F.explode(F.array_distinct("workflow_ctx_from")).alias("node_id"))
    told = nodes.filter("is_subworkflow and sub_workflow_summary is not null").select("workflow_id", "node_id", "sub_workflow_summary")
    met = wanted.join(told, ["workflow_id", "node_id"])
    return met.groupBy("workflow_id", "task_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "sub_workflow_summary")))).alias("summaries"))


def node_config(nodes: DataFrame, workflows: DataFrame) -> DataFrame:
    """A node's settings with its workflow's state, depth and root."""
    flow = workflows.select(F.col("id").alias("workflow_id"), F.col("status").alias("workflow_status"), "depth", "root_workflow_id")
    return nodes.join(flow, "workflow_id").select("workflow_id", "task_index", "status", "join_type", "min_success", "allow_failed_deps", "is_subworkflow", "workflow_status", "depth", "root_workflow_id")


def delayed_messages(tasks: DataFrame, as_of: Column) -> DataFrame:
    """(channel, payload, deliver_at): the messages that tasks waiting for a retry send to their queue when it is due."""
    waiting = tasks.filter((F.col("status") == "PENDING") & (F.col("next_retry_at") > as_of))
    return waiting.select(F.concat(F.lit("task_queue_"), F.col("queue_name")).alias("channel"), F.col("id").alias("payload"), F.col("next_retry_at").alias("deliver_at"))


def channels(kind: str, was: Column, to: Column, queue_name: Column) -> Column:
    """Array of the channels that hear of a change of state, some of them null: of tasks ("task"), workflows ("workflow") or others.

    Fixed values: the names of the channels.
    """
    created = was.isNull()
    told = [F.lit(f"{kind}_status")]
    if kind == "task":
        pending = created & (to == "PENDING")
        told += [F.when(pending, "task_new"), F.when(pending, F.concat(F.lit("task_queue_"), queue_name)), F.when(~created & to.isin("COMPLETED", "FAILED", "CANCELLED", "EXPIRED"), "task_done")]
    elif kind == "workflow":
        told += [F.when(~created & to.isin("COMPLETED", "FAILED", "CANCELLED", "PAUSED"), "workflow_done")]
    return F.array(*told)


def notifications(old: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """(channel, payload) messages between two states of the tasks ("task") or workflows ("workflow")."""
    queue = ["queue_name"] if kind == "task" else []
    a, b = old.select("id", F.col("status").alias("_old")), new.select("id", F.col("status").alias("_new"), *queue)
    moved = b.join(a, "id", "left").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    told = channels(kind, F.col("_old"), F.col("_new"), F.col("queue_name") if queue else F.lit(None).cast("string"))
    return moved.select(F.explode(told).alias("channel"), F.col("id").alias("payload")).filter("channel is not null")
