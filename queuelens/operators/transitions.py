"""State transitions as functions from one state of a table to the next.

Parquet has no updates in place, so a guarded update is a projection: rows
that pass the guard get new values, all others keep theirs, and a flag tells
which ones changed. Guards are evaluated on the old values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions import results
from queuelens.functions.times import ago, seconds
from queuelens.operators.health import is_stale_claimed, is_stale_running, with_heartbeat
from queuelens.schemas import NODE_TERMINAL


def update(df: DataFrame, guard: Column, changes: dict[str, Column], flag: str = "changed") -> DataFrame:
    """`df` with `changes` where `guard` holds, and the flag. It must have all columns that change (see `schemas.complete`)."""
    if lacking := [c for c in changes if c not in df.columns]:
        raise ValueError(f"the table lacks {', '.join(lacking)}")
    hit = F.coalesce(guard, F.lit(False))
    return df.withColumns({c: F.when(hit, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()} | {flag: hit})


def RELEASED(as_of: Column) -> dict[str, Column]:
    """What a task loses with its claim."""
    none = F.lit(None)
    return {"claimed": F.lit(False), "claimed_at": none, "claimed_by_worker_id": none, "claim_expires_at": none, "updated_at": as_of}


# ---- tasks -----------------------------------------------------------------


def unclaim(tasks: DataFrame, as_of: Column, which: Column, owner: str | None = None) -> DataFrame:
    """Back to PENDING; with an owner only tasks that it holds."""
    guard = which if owner is None else which & (F.col("status") == "CLAIMED") & (F.col("claimed_by_worker_id") == owner)
    return update(tasks, guard, {"status": F.lit("PENDING"), **RELEASED(as_of)})


def cancel_tasks(tasks: DataFrame, as_of: Column, which: Column) -> DataFrame:
    return update(tasks, which & F.col("status").isin("CLAIMED", "PENDING"), {"status": F.lit("CANCELLED"), **RELEASED(as_of)})


#: Fixed value: what an expired task is told.
_TOO_LATE = "'Task expired: good_until deadline passed before execution started'"


def expire_pending(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Pending tasks past their deadline end as EXPIRED, with a result that says so."""
    late = (F.col("status") == "PENDING") & (F.col("good_until") <= as_of)
    told = F.expr(results.failed(results.error(f"'{results.EXPIRED}'", _TOO_LATE)))
    return update(tasks, late, {"status": F.lit("EXPIRED"), "failed_at": as_of, "result": told, "error_code": F.lit(results.EXPIRED), "updated_at": as_of})


def expire_claimed(tasks: DataFrame, as_of: Column, owner: str) -> DataFrame:
    """A worker's claimed tasks whose deadline passed before they started. They still say who claimed them, and when."""
    late = (F.col("status") == "CLAIMED") & (F.col("claimed_by_worker_id") == owner) & (F.col("good_until") <= as_of)
    data = results.obj(task_id=results.text("id"), worker_id=results.text("claimed_by_worker_id"))
    told = F.expr(results.failed(results.error(f"'{results.EXPIRED}'", _TOO_LATE, data)))
    changes = {"status": F.lit("EXPIRED"), "claimed": F.lit(False), "claim_expires_at": F.lit(None), "failed_at": as_of, "result": told, "error_code": F.lit(results.EXPIRED), "updated_at": as_of}
    return update(tasks, late, changes)


def start_claimed(tasks: DataFrame, stopped: DataFrame, as_of: Column, owner: str) -> DataFrame:
    """CLAIMED to RUNNING, for the owner, under a valid lease and deadline, unless the workflow is stopped.

    `stopped` lists the ids of tasks whose workflow is paused or cancelled.
    """
    blocked = stopped.select(F.col("id").alias("_id"), F.lit(True).alias("_stop")).distinct()
    flagged = tasks.join(blocked, F.col("id") == F.col("_id"), "left")
    valid = (F.col("claim_expires_at").isNull() | (F.col("claim_expires_at") > as_of)) & (F.col("good_until").isNull() | (F.col("good_until") > as_of))
    guard = (F.col("status") == "CLAIMED") & (F.col("claimed_by_worker_id") == owner) & valid & F.col("_stop").isNull()
    return update(flagged, guard, {"status": F.lit("RUNNING"), "claimed": F.lit(False), "started_at": as_of, "claim_expires_at": F.lit(None), "updated_at": as_of}).drop("_id", "_stop")


def requeue_claimed(tasks: DataFrame, heartbeats: DataFrame, as_of: Column, threshold: int = 120, claimed_at: str = "claimed_at") -> DataFrame:
    """Claims whose claimer is silent are given back."""
    seen = with_heartbeat(tasks, heartbeats, "claimer")
    return update(seen, is_stale_claimed(as_of, threshold, claimed_at), {"status": F.lit("PENDING"), **RELEASED(as_of)}).drop("last_heartbeat")


def stale_reason(threshold: int) -> str:
    """Why a silent task fails."""
    return f"Worker process crashed (no runner heartbeat for {threshold * 1000}ms = {float(threshold):.1f}s)"


def mark_stale_failed(tasks: DataFrame, heartbeats: DataFrame, as_of: Column, threshold: int = 300) -> DataFrame:
    """Running tasks without a sign of life fail with WORKER_CRASHED, and a result that says who ran them and since when."""
    seen = with_heartbeat(tasks, heartbeats, "runner").withColumn("_now", as_of)
    iso = lambda c: f"""'"' || date_format({c}, "yyyy-MM-dd'T'HH:mm:ss") || case when date_format({c}, 'SSSSSS') = '000000' then '' else date_format({c}, '.SSSSSS') end || '+00:00"'"""
    own = lambda c, as_text: (results.text(c) if as_text else f"cast({c} as string)") if c in tasks.columns else "null"
    data = results.obj(
        stale_threshold_ms=f"'{threshold * 1000}'", stale_threshold_seconds=f"'{float(threshold):.1f}'", worker_pid=own("worker_pid", False), worker_hostname=own("worker_hostname", True),
        worker_id=results.text("claimed_by_worker_id"), started_at=iso("started_at"), detected_at=iso("_now"),
    )
    reason = stale_reason(threshold)
    told = F.expr(results.failed(results.error(f"'{results.CRASHED}'", f"'{reason}'", data)))
    changes = {"status": F.lit("FAILED"), "failed_at": as_of, "failed_reason": F.lit(reason), "result": told, "error_code": F.lit(results.CRASHED), "updated_at": as_of}
    return update(seen, is_stale_running(as_of, threshold), changes).drop("last_heartbeat", "_now")


def renew_leases(tasks: DataFrame, as_of: Column, owner: str, lease: int = 60, max_age: int = 180, claimed_at: str = "claimed_at") -> DataFrame:
    """A worker's leases run on, unless the claim is older than `max_age` seconds."""
    guard = (F.col("status") == "CLAIMED") & (F.col("claimed_by_worker_id") == owner) & (F.col(claimed_at) >= ago(as_of, max_age))
    return update(tasks, guard, {"claim_expires_at": as_of + seconds(lease), "updated_at": as_of})


def finalize(tasks: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Running tasks end as `outcomes` (task_id, ok, result, error_code, failed_reason) say.

    Tasks that no longer run keep their state. An outcome without result is a
    failure of the worker itself: no error code is stored then.
    """
    # One outcome per task: of repeated ones the first by content.
    once = outcomes.groupBy("task_id").agg(F.min(F.struct("ok", "result", "error_code", "failed_reason")).alias("_o"))
    seen = tasks.join(once, tasks.id == F.col("task_id"), "left").drop("task_id")
    ok, own = F.coalesce(F.col("_o.ok"), F.lit(False)), F.col("_o").isNotNull() & (F.col("status") == "RUNNING")
    changes = {
        "status": F.when(ok, "COMPLETED").otherwise("FAILED"), "result": F.col("_o.result"), "error_code": F.when(~ok & F.col("_o.result").isNotNull(), F.col("_o.error_code")), "updated_at": as_of,
        "completed_at": F.when(ok, as_of).otherwise(F.col("completed_at")), "failed_at": F.when(ok, F.col("failed_at")).otherwise(as_of), "failed_reason": F.col("_o.failed_reason"),
    }
    return update(seen, own, changes).drop("_o")


def attempts_of(tasks: DataFrame, outcomes: DataFrame, as_of: Column, plan: DataFrame | None = None) -> DataFrame:
    """The attempt rows that ending tasks leave: the number is retry_count + 1.

    A failed attempt has `will_retry` if `plan` (id, verdict) schedules another one.
    """
    running = tasks.filter("status = 'RUNNING'").select("id", "retry_count", "started_at", "claimed_by_worker_id")
    if plan is None:
        running = running.withColumn("_again", F.lit(False))
    else:
        again = plan.filter("verdict = 'scheduled'").select(F.col("id"), F.lit(True).alias("_again")).distinct()
        running = running.join(again, "id", "left")
    ends = running.join(outcomes, F.col("id") == F.col("task_id"))
    outcome = F.when(F.col("ok"), "COMPLETED").when(F.col("result").isNull(), "WORKER_FAILURE").otherwise("FAILED")
    return ends.select("task_id", (F.col("retry_count") + 1).alias("attempt"), outcome.alias("outcome"), ((outcome == "FAILED") & F.coalesce("_again", F.lit(False))).alias("will_retry"), "started_at", as_of.alias("finished_at"), "error_code", F.col("claimed_by_worker_id").alias("worker_id"))


def upsert_attempts(attempts: DataFrame, new: DataFrame) -> DataFrame:
    """Attempts with `new` rows (one for each key) in place of old ones of the same (task_id, attempt)."""
    key = ["task_id", "attempt"]
    return attempts.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(attempts.columns)).select(attempts.columns)


def claimer_heartbeats(tasks: DataFrame, as_of: Column, worker: str, hostname: str, pid: int) -> DataFrame:
    """The heartbeats that a worker sends for the tasks that it has claimed."""
    own = tasks.filter((F.col("status") == "CLAIMED") & (F.col("claimed_by_worker_id") == worker))
    return own.select(F.col("id").alias("task_id"), F.lit(worker).alias("sender_id"), F.lit("claimer").alias("role"), as_of.alias("sent_at"), F.lit(hostname).alias("hostname"), F.lit(pid).alias("pid"))


def enqueue(tasks: DataFrame, incoming: DataFrame) -> DataFrame:
    """`incoming` tasks with `verdict`: new, same (sent again), or mismatch (other content under a known id)."""
    known = tasks.select(F.col("id").alias("_id"), F.col("enqueue_sha").alias("_sha"))
    verdict = F.when(F.col("_id").isNull(), "new").when(F.col("_sha") == F.col("enqueue_sha"), "same").otherwise("mismatch")
    return incoming.join(known, F.col("id") == F.col("_id"), "left").withColumn("verdict", verdict).drop("_id", "_sha")


# ---- nodes and workflows ---------------------------------------------------


def move_nodes(nodes: DataFrame, which: Column, to: str, *, only: tuple[str, ...] | None = None, **changes: Column) -> DataFrame:
    """Nodes that match go to a state; `only` lists the states they may come from."""
    guard = which if only is None else which & F.col("status").isin(*only)
    return update(nodes, guard, {"status": F.lit(to), **changes})


def mark_ready(nodes: DataFrame, which: Column) -> DataFrame:
    return move_nodes(nodes, which, "READY", only=("PENDING",))


def skip_nodes(nodes: DataFrame, which: Column, as_of: Column) -> DataFrame:
    return move_nodes(nodes, which, "SKIPPED", only=("PENDING", "READY", "ENQUEUED"), completed_at=as_of)


def reset_nodes(nodes: DataFrame, which: Column) -> DataFrame:
    """Nodes of paused workflows wait again; their tasks are forgotten."""
    return update(nodes, which, {"status": F.lit("READY"), "task_id": F.lit(None), "started_at": F.lit(None)})


def reset_subworkflows(nodes: DataFrame, which: Column) -> DataFrame:
    """READY sub-workflow nodes that match wait again, for a later start of their child."""
    return move_nodes(nodes, which & F.col("is_subworkflow"), "PENDING", only=("READY",))


def end_nodes(nodes: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Nodes take the states and results of `outcomes` (workflow_id, task_index, to, outcome), unless they have ended.

    A `summary` of a child workflow in `outcomes` is the node's then, if it has a column for it.
    """
    with_summary = "summary" in outcomes.columns and "sub_workflow_summary" in nodes.columns
    once = outcomes.groupBy("workflow_id", "task_index").agg(F.min(F.struct("to", "outcome", *(["summary"] if with_summary else []))).alias("_r"))
    seen = nodes.join(once, ["workflow_id", "task_index"], "left")
    guard = F.col("_r").isNotNull() & ~F.col("status").isin(*NODE_TERMINAL)
    more = {"sub_workflow_summary": F.coalesce("_r.summary", "sub_workflow_summary")} if with_summary else {}
    return update(seen, guard, {"status": F.col("_r.to"), "result": F.col("_r.outcome"), "completed_at": as_of, **more}).drop("_r").select(*nodes.columns, "changed")


def enqueue_nodes(nodes: DataFrame, workflows: DataFrame, as_of: Column, subworkflows: bool = False) -> DataFrame:
    """READY nodes of running workflows become ENQUEUED."""
    live = workflows.filter("status = 'RUNNING'").select(F.col("id").alias("workflow_id"), F.lit(True).alias("_live"))
    guard = (F.col("status") == "READY") & F.col("_live") & (F.col("is_subworkflow") if subworkflows else ~F.col("is_subworkflow"))
    return update(nodes.join(live, "workflow_id", "left"), guard, {"status": F.lit("ENQUEUED"), "started_at": as_of}).drop("_live").select(*nodes.columns, "changed")


def move_workflows(workflows: DataFrame, which: Column, to: str, only: tuple[str, ...], as_of: Column) -> DataFrame:
    return update(workflows, which & F.col("status").isin(*only), {"status": F.lit(to), "updated_at": as_of})


def pause(workflows: DataFrame, which: Column, as_of: Column) -> DataFrame:
    return move_workflows(workflows, which, "PAUSED", ("RUNNING",), as_of)


def resume(workflows: DataFrame, which: Column, as_of: Column) -> DataFrame:
    return move_workflows(workflows, which, "RUNNING", ("PAUSED",), as_of)


def descendants(workflows: DataFrame, start: Column, through: str) -> DataFrame:
    """(id) of the matching workflows and of all below them, reached over children in state `through`.

    One level of the tree is joined in a round; the rounds are as many as the
    tree is deep, and end with the first level that is empty.
    """
    level = workflows.filter(start & (F.col("status") == through)).select("id")
    children = workflows.filter(F.col("status") == through).select(F.col("id").alias("child"), F.col("parent_workflow_id").alias("id")).filter("id is not null")
    found = level
    for _ in range(int(workflows.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0])):
        level = level.join(children, "id").select(F.col("child").alias("id"))
        found = found.unionByName(level)
    return found.distinct()


def children(workflows: DataFrame, status: str) -> DataFrame:
    """(id, parent_workflow_id, depth, root_workflow_id) of the child workflows in a state."""
    return workflows.filter((F.col("status") == status) & F.col("parent_workflow_id").isNotNull()).select("id", "parent_workflow_id", "depth", "root_workflow_id")


def cascade(workflows: DataFrame, start: Column, through: str, to: str, as_of: Column) -> DataFrame:
    """Pause (RUNNING to PAUSED) or resume (PAUSED to RUNNING) workflows with all their children."""
    below = descendants(workflows, start, through).select(F.col("id").alias("_id"))
    seen = workflows.join(below, F.col("id") == F.col("_id"), "left")
    return update(seen, F.col("_id").isNotNull(), {"status": F.lit(to), "updated_at": as_of}).drop("_id")


def cancel_workflows(workflows: DataFrame, nodes: DataFrame, tasks: DataFrame, which: Column, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(workflows, nodes, tasks) after cancelling the matching workflows.

    Nodes whose task runs already are RUNNING; tasks that have not started are
    cancelled; waiting nodes, and those whose task is cancelled, are skipped.
    """
    done = move_workflows(workflows, which, "CANCELLED", ("PENDING", "RUNNING", "PAUSED"), as_of)
    hit = workflows.filter(which).select(F.col("id").alias("workflow_id"), F.lit(True).alias("_hit"))
    seen = nodes.join(hit, "workflow_id", "left")
    state = tasks.select(F.col("id").alias("task_id"), F.col("status").alias("_task"))
    seen = seen.join(state, "task_id", "left")
    enqueued = F.col("_hit") & (F.col("status") == "ENQUEUED")
    new = (
        F.when(enqueued & (F.col("_task") == "RUNNING"), "RUNNING")
        .when(enqueued & F.col("_task").isin("PENDING", "CLAIMED", "CANCELLED"), "SKIPPED")
        .when(F.col("_hit") & F.col("status").isin("PENDING", "READY"), "SKIPPED")
    )
    dropped = seen.filter(enqueued & F.col("_task").isin("PENDING", "CLAIMED")).select(F.col("task_id").alias("_id")).distinct()
    moved = update(seen, new.isNotNull(), {"status": new}).drop("_hit", "_task").select(*nodes.columns, "changed")
    ended = tasks.join(dropped, F.col("id") == F.col("_id"), "left")
    ended = update(ended, F.col("_id").isNotNull(), {"status": F.lit("CANCELLED"), **RELEASED(as_of)}).drop("_id")
    return done, moved, ended


def start_workflow(spec: DataFrame, as_of: Column) -> DataFrame:
    """Nodes of new workflows: those without dependencies are READY, all others PENDING."""
    return spec.withColumn("status", F.when(F.size("dependencies") == 0, "READY").otherwise("PENDING")).withColumn("created_at", as_of)


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(channel, payload) events of the rows whose state differs between two states of a table."""
    a, b = old.select(key, F.col("status").alias("_old")), new.select(key, F.col("status").alias("_new"))
    moved = a.join(b, key, "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    channel = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isin("COMPLETED", "FAILED", "CANCELLED", "EXPIRED"), "done").otherwise("status")
    return moved.select(channel.alias("channel"), F.col(key).alias("payload"), F.col("_old").alias("was"), F.col("_new").alias("status"))


