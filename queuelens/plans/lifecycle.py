"""Queries on updates that follow from verdicts, by name, with their oracles."""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import functions as F

from queuelens import schemas
from queuelens.functions import ids, schedule, tagged
from queuelens.operators import claim as C
from queuelens.operators import dag as D
from queuelens.operators import engine as E
from queuelens.operators import enqueue as Q
from queuelens.operators import lifecycle as L
from queuelens.operators import monitor as M
from queuelens.operators import retention as R
from queuelens.operators import transitions as T
from queuelens.plans import resultsql as X
from queuelens.plans.state import _CLAIMABLE as _OPEN
from queuelens.plans.state import CRASHED, REASON, _ISO, _UUID, _ACTIVE, _ALLOC, _ENDED, _HB, _N, _WF_ENDED, DAY, NOW, caps, full
from queuelens.sources.fixtures import oracle
from queuelens.sources.tables import Tables

_POLICY = ('{"retry_policy":{"intervals":[10,20],"backoff_strategy":"fixed","max_retries":2},"auto_retry_for":["WORKER_CRASHED","TASK_EXCEPTION"]}', '{"retry_policy":{"intervals":[30],"backoff_strategy":"exponential"},"auto_retry_for":["WORKER_CRASHED"],"good_until":"2024-02-01T00:00:00"}')


def _number(column: str):
    return F.regexp_extract(column, r"(\d+)$", 1).cast("long")


def _options(by):
    return F.when(by % 3 == 0, _POLICY[0]).when(by % 3 == 1, _POLICY[1])


def equipped(t: Tables) -> Tables:
    """Full tables: tasks and nodes with options and arguments, every fifth ended task with a result, nodes with names of tasks."""
    t = full(t)
    n = _number("id")
    tasks = t.tasks.withColumns({"task_options": _options(_number("task_name")), "result": F.when(n % 5 == 0, '{"ok":1}').when(n % 5 == 1, '{"err":{"error_code":"X"}}').when(n % 5 == 2, '{"o')})
    i = F.col("task_index")
    nodes = t.workflow_tasks.withColumns({
        "task_name": F.concat(F.lit("fn_"), (i % 4).cast("string")), "queue_name": F.lit("main"), "priority": (i + 1).cast("int"), "task_args": F.lit("[1]"), "task_options": _options(i),
        "task_kwargs": F.when(i % 3 == 0, '{"d0": 1}'), "args_from": F.map_from_arrays(F.transform("dependencies", lambda d: F.concat(F.lit("d"), d.cast("string"))), "dependencies"),
        "workflow_ctx_from": F.transform("dependencies", lambda d: F.concat(F.lit("n"), d.cast("string"))), "sub_workflow_summary": F.when(F.col("is_subworkflow"), F.concat(F.lit('{"total":'), i.cast("string"), F.lit("}"))),
    })
    return replace(t, tasks=tasks, workflow_tasks=nodes)


def outcomes(t: Tables):
    """Outcomes of a third of the tasks: success, failure by an exception, or loss of the worker."""
    n = _number("id")
    kind = F.pmod(n, F.lit(9))
    return t.tasks.filter(n % 3 == 0).select(F.col("id").alias("task_id"), (kind == 0).alias("ok"), F.when(kind != 6, F.when(kind == 0, '{"ok":1}').otherwise('{"err":2}')).alias("result"), F.when(kind == 3, F.lit("TASK_EXCEPTION")).alias("error_code"), F.when(kind == 6, F.lit("worker lost")).alias("failed_reason"))


_RETRY = ("id", "status", "retry_count", "next_retry_at", "enqueued_at", "error_code", "updated_at", "changed")
_CLAIM = ("claimed", "claimed_at", "claimed_by_worker_id", "claim_expires_at")
_FLOW = ("id", "status", "result", "error", "completed_at", "updated_at")


def _plan(t: Tables):
    """A retry in a hundred seconds for every second task."""
    return t.tasks.filter(_number("id") % 2 == 0).select("id", (t.as_of + F.expr("interval 100 second")).alias("retry_at"))


def _attempts(t: Tables):
    return T.attempts_of(t.tasks, outcomes(t), t.as_of, L.outcome_plan(t.tasks, outcomes(t), t.as_of))


def _both(pair):
    flows, nodes = pair
    rows = flows.select(F.lit("workflow").alias("kind"), "id", "status", "result", "error")
    return rows.unionByName(nodes.select(F.lit("node").alias("kind"), "id", "status", "result", F.lit(None).cast("string").alias("error")))


def _children(t: Tables):
    return Q.children_of(t.workflow_tasks, t.workflows, t.as_of)


def _definitions(t: Tables):
    """Three nodes for each name of a workflow: a root, and two that depend on what is before them."""
    names = t.workflows.select("name").distinct()
    return names.select("name", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("task_index")).withColumns({"node_id": F.concat(F.lit("n"), F.col("task_index").cast("string")), "dependencies": F.when(F.col("task_index") == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("task_index") - 1))})


def _config(t: Tables):
    """Configured schedules: all but every fourth, some changed, and a new one."""
    n = _number("schedule_name")
    old = t.schedule_state.filter(n % 4 != 0).select("schedule_name", F.when(n % 4 == 1, "new").otherwise("old").alias("config_hash"), (t.as_of + F.expr("interval 1 hour")).alias("next_run"))
    return old.unionByName(old.limit(1).select(F.lit("added").alias("schedule_name"), F.lit("new").alias("config_hash"), "next_run"))


def _synced(t: Tables):
    state = full(t).schedule_state.withColumn("config_hash", F.lit("old"))
    return schedule.sync(state, _config(t), t.as_of).select("schedule_name", "next_run_at", "config_hash", "run_count", "updated_at", "last_run_at")


_PATTERNS = (schedule.Interval(5400), schedule.Hourly(20, 5), schedule.Daily(3, 30), schedule.Weekly(("tuesday", "friday"), 9, 45), schedule.Monthly(31, 6))


def _schedules(t: Tables):
    """All schedules: five patterns in three time zones, half of them catching up, some not enabled."""
    n = _number("schedule_name")
    pick = lambda of, xs: functools.reduce(lambda w, i: w.when(of == i, xs[i]), range(1, len(xs)), F.when(of == 0, xs[0]))
    pattern = pick(n % 5, [schedule.pattern_of(p) for p in _PATTERNS])
    zone = pick(n % 3, [F.lit(z) for z in ("UTC", "Europe/Berlin", "America/New_York")])
    return t.schedule_state.select("schedule_name", pattern.alias("pattern"), zone.alias("timezone"), (n % 7 != 3).alias("enabled"), (n % 2 == 0).alias("catch_up_missed"), F.lit(3).alias("max_catch_up_runs"))


def _ticked(t: Tables, catch_up: int):
    n = _number("schedule_name")
    done = (n % 3).cast("int") if catch_up else None
    ran = schedule.tick(full(t).schedule_state, schedule.Daily(3), t.as_of, catch_up=catch_up, done=done)
    return ran.select("schedule_name", "last_run_at", "next_run_at", "run_count", "updated_at", F.size("slots").alias("n_slots"))


QUERIES = {
    # retries
    "schedule_retry": lambda t: L.schedule_retries(full(t).tasks, _plan(t), t.as_of).select(*_RETRY),
    "schedule_stale_retry": lambda t: L.schedule_stale_retries(full(t).tasks, t.heartbeats, _plan(t), t.as_of).select(*_RETRY, *_CLAIM),
    "settle_stale": lambda t: L.settle_stale(equipped(t).tasks, t.heartbeats, t.as_of).select(*_RETRY, "failed_at", "failed_reason", "result"),
    "stale_attempts": lambda t: L.stale_attempts(equipped(t).tasks, t.heartbeats, t.as_of).drop("worker_process_name"),
    "finalize_or_retry": lambda t: L.finalize_or_retry(equipped(t).tasks, outcomes(t), t.as_of).select(*_RETRY, "result", "completed_at", "failed_at", "failed_reason"),
    "attempts_with_retry": lambda t: _attempts(equipped(t)),
    # claims and starts
    "unclaim": lambda t: T.unclaim(full(t).tasks, t.as_of, _number("id") % 3 == 0, "worker-7").select("id", "status", "updated_at", "changed", *_CLAIM),
    "expire_claimed": lambda t: T.expire_claimed(full(t).tasks, t.as_of, "worker-7").select("id", "status", "error_code", "result", "failed_at", "updated_at", "changed", *_CLAIM),
    "reset_nodes": lambda t: T.reset_nodes(full(t).workflow_tasks, (F.col("status") == "ENQUEUED") & (F.col("task_index") % 2 == 0)).select("id", "status", "task_id", "started_at", "changed"),
    "skip_nodes": lambda t: T.skip_nodes(full(t).workflow_tasks, F.col("task_index") % 2 == 0, t.as_of).select("id", "status", "completed_at", "changed"),
    "guard_nodes": lambda t: L.guard_nodes(full(t).workflow_tasks, t.tasks, t.workflows, t.as_of).select("id", "status", "task_id", "completed_at", "changed"),
    "start_nodes": lambda t: L.start_nodes(full(t).workflow_tasks, t.tasks.filter("status = 'RUNNING'"), t.workflows, t.as_of).select("id", "status", "started_at", "changed"),
    "mark_ready": lambda t: T.mark_ready(full(t).workflow_tasks, F.col("task_index") % 2 == 1).select("id", "status", "changed"),
    "end_ready_nodes": lambda t: T.move_nodes(full(t).workflow_tasks, F.col("task_index") % 3 == 1, "FAILED", only=("READY",), result=F.lit('{"err":1}'), completed_at=t.as_of).select("id", "status", "result", "completed_at", "changed"),
    "enqueue_subworkflows": lambda t: T.enqueue_nodes(full(t).workflow_tasks, t.workflows, t.as_of, subworkflows=True).select("id", "status", "started_at", "changed"),
    "reset_subworkflows": lambda t: T.reset_subworkflows(full(t).workflow_tasks, F.lit(True)).select("id", "status", "changed"),
    "claim_limit": lambda t: _claim_limit(t),
    "claim_budget": lambda t: _budgets(t),
    "claims_of_workers": lambda t: C.claims_of_workers(t.tasks, _fleet(t), caps(t), t.as_of, 60000),
    "claim_all": lambda t: C.claim_all(full(t).tasks, C.claims_of_workers(t.tasks, _fleet(t), caps(t), t.as_of), t.as_of).select("id", "status", "updated_at", "changed", *_CLAIM),
    "delayed_messages": lambda t: L.delayed_messages(t.tasks, t.as_of),
    "task_of_workflow": lambda t: L.of_workflows(t.tasks, t.workflow_tasks),
    # inserts
    "insert_workflows": lambda t: L.insert(t.workflows, _children(t).unionByName(t.workflows.select("id", "name", F.lit("PENDING").alias("status"), "parent_workflow_id", "parent_task_index", "depth", "root_workflow_id", "created_at"))).select("id", "name", "status", "depth"),
    "link_children": lambda t: L.link_children(full(t).workflow_tasks, _children(t)).select("id", "status", "sub_workflow_id", "changed"),
    "expand_children": lambda t: L.expand(_children(t), _definitions(t), t.as_of).select("id", "workflow_id", "task_index", "node_id", "status", "created_at"),
    "materialise_nodes": lambda t: E.materialise(equipped(t).workflow_tasks, t.as_of),
    "append_snapshots": lambda t: L.append(t.worker_states, t.worker_states.select((-F.col("id")).alias("id"), "worker_id", t.as_of.alias("snapshot_at"))).select("id", "worker_id", "snapshot_at"),
    "append_heartbeats": lambda t: L.append(t.heartbeats, T.claimer_heartbeats(full(t).tasks, t.as_of, "worker-7", "host-1", 7)).select("task_id", "sender_id", "role", "sent_at"),
    # completions
    "failure_errors": lambda t: L.failure_errors(t.workflows, t.workflow_tasks),
    "apply_completions": lambda t: L.apply_completions(full(t).workflows, t.workflow_tasks, t.as_of).select(*_FLOW, "changed"),
    "apply_on_error": lambda t: L.apply_on_error(full(t).workflows, t.workflow_tasks, t.as_of).select("id", "status", "error", "updated_at", "changed"),
    "nodes_of_tasks": lambda t: L.nodes_of_tasks(t.workflow_tasks, outcomes(t)),
    "complete_nodes": lambda t: _both(E.complete_nodes(full(t).workflows, _no_context(t), outcomes(t), t.as_of)),
    "crashed_results": lambda t: L.crashed_results(t.workflow_tasks, equipped(t).tasks, t.workflows),
    "recovery_repair": lambda t: _both(E.recover(full(t).workflows, _loose(t), equipped(t).tasks, t.as_of)[:2]),
    "resume_all": lambda t: _both(E.resume_all(full(t).workflows, _no_context(t), F.lit(True), t.as_of)[:2]),
    "resume_cascade": lambda t: T.cascade(full(t).workflows.withColumn("status", F.when(F.col("status") == "COMPLETED", "PAUSED").otherwise(F.col("status"))), F.col("parent_workflow_id").isNull(), "PAUSED", "RUNNING", t.as_of).select("id", "status", "changed"),
    "reaper_round": lambda t: L.reap(equipped(t).tasks, t.heartbeats, t.as_of).select("id", "status", "retry_count", "claimed_by_worker_id", "error_code", "changed"),
    # lookups
    "node_results": lambda t: L.node_results(t.workflow_tasks),
    "node_result": lambda t: L.node_results(t.workflow_tasks, "n1"),
    "workflow_outcome": lambda t: L.apply_completions(full(t).workflows, t.workflow_tasks, t.as_of).filter("status in ('COMPLETED', 'FAILED')").select("id", "result", "error"),
    "node_summaries": lambda t: L.summaries(equipped(t).workflow_tasks).select("workflow_id", "task_index", F.explode("summaries").alias("node_id", "summary")),
    "node_config": lambda t: L.node_config(t.workflow_tasks, t.workflows),
    "pending_nodes": lambda t: D.waiting(t.workflow_tasks),
    "ready_nodes": lambda t: D.ready(t.workflow_tasks),
    "paused_children": lambda t: T.children(t.workflows.withColumn("status", F.when(F.col("status") == "COMPLETED", "PAUSED").otherwise(F.col("status"))), "PAUSED"),
    "task_notifications": lambda t: L.notifications(t.tasks, L.insert(T.expire_pending(full(t).tasks, t.as_of).select("id", "status", "queue_name"), t.tasks.select(F.concat("id", F.lit("-new")).alias("id"), F.lit("PENDING").alias("status"), "queue_name")), "task"),
    "workflow_notifications": lambda t: L.notifications(t.workflows, T.pause(full(t).workflows, F.lit(True), t.as_of), "workflow"),
    "workflow_statuses": lambda t: M.workflow_totals(t.workflows),
    # retention, schedules, identifiers
    "retention_attempts": lambda t: R.keep_attempts(t.task_attempts, R.keep_tasks(t.tasks, t.workflow_tasks, t.workflows, t.as_of, DAY)).select("task_id", "attempt", "outcome"),
    "schedule_tick": lambda t: _ticked(t, 0),
    "schedule_catch_up": lambda t: _ticked(t, 5),
    "schedule_sync": _synced,
    "schedule_ticks": lambda t: schedule.tick_all(full(t).schedule_state, _schedules(t), t.as_of)[0].select("schedule_name", "last_run_at", "next_run_at", "run_count", "last_task_id", "updated_at"),
    "schedule_runs": lambda t: schedule.tick_all(full(t).schedule_state, _schedules(t), t.as_of)[1],
    "schedule_hashes": lambda t: _schedules(t).select("schedule_name", schedule.config_hash_of(F.col("pattern"), F.col("timezone")).alias("config_hash")),
    "advisory_key": lambda t: t.schedule_state.select("schedule_name", ids.advisory_key(F.col("schedule_name")).alias("key")),
    "upgrade_tasks": lambda t: _upgraded(t),
    "upgrade_attempts": lambda t: schemas.upgrade_attempts(t.task_attempts.drop("will_retry", "worker_id"), t.tasks, t.as_of).select("task_id", "attempt", "will_retry", "worker_id", "worker_process_name", "created_at"),
    "tagged_values": lambda t: _tagged(t),
    "nested_values": lambda t: tagged.nested(_nested(t), "id", "text"),
    "nested_definitions": lambda t: D.nested_definitions(_uses(t)),
}


def _no_context(t: Tables):
    """Nodes that ask for no context."""
    return full(t).workflow_tasks


def _loose(t: Tables):
    """The same, READY nodes at odd places without a task."""
    return _no_context(t).withColumn("task_id", F.when((F.col("status") == "READY") & (F.col("task_index") % 2 == 1), None).otherwise(F.col("task_id")))


def _upgraded(t: Tables):
    """Tasks of an old schema: half of them without an instant of enqueueing, all without those of sending and without fingerprint."""
    old = t.tasks.withColumn("enqueued_at", F.when(_number("id") % 2 == 0, F.col("enqueued_at")))
    return schemas.upgrade_tasks(old, t.as_of).select("id", F.col("enqueued_at").cast("timestamp_ntz").alias("enqueued_at"), "enqueue_sha")


def _tagged(t: Tables):
    """Encoded values by kind, and what they decode to."""
    n = _number("id") % 5
    text = F.when(n == 0, tagged.encode_timestamp(F.col("enqueued_at").cast("timestamp"))).when(n == 1, '{"__date__":true,"value":"2024-02-29"}').when(n == 2, tagged.encode_result(F.lit("7"), F.lit(None).cast("string"))).when(n == 3, '{"x": 1}').otherwise("{no json")
    rows = t.tasks.select("id", text.alias("text"))
    return rows.select("id", tagged.kind(F.col("text")).alias("kind"), tagged.as_timestamp(F.col("text")).cast("timestamp_ntz").alias("at"), tagged.as_date(F.col("text")).alias("day"), tagged.decode_result(F.col("text"))["ok"].alias("ok"))


def _nested(t: Tables):
    """Tagged values in lists, objects and results; every fifth date is damaged, every seventh text is no JSON."""
    n = _number("id")
    day = F.when(n % 5 == 0, "2024-13-01").otherwise("2024-02-29")
    text = F.concat(F.lit('{"a":[1,{"__datetime__":true,"value":"2024-01-31T00:00:00+00:00"},{"b":{"__date__":true,"value":"'), day, F.lit('"}}],"c":{"__task_result__":true,"ok":{"d":["x",'), n.cast("string"), F.lit(']},"err":null},"e":{"__future__":true,"value":"y"},"f":{},"g":{"__date__":false}}'))
    return t.tasks.select("id", F.when(n % 7 == 0, "{no json").otherwise(text).alias("text"))


def _uses(t: Tables):
    """Definitions by number that use each other: chains, and a loop for every seventh."""
    n = t.workflows.select(_number("id").alias("n"))
    of = lambda c: F.concat(F.lit("d"), c.cast("string"))
    return n.filter("n % 7 < 3").select(of(F.col("n")).alias("name"), F.when(F.col("n") % 7 == 2, of(F.col("n") - 2)).otherwise(of(F.col("n") + 1)).alias("uses")).filter("name <> 'd0' and uses <> 'd0'").unionByName(n.filter("n % 7 = 4").select(of(F.col("n")).alias("name"), of(F.col("n") + 1).alias("uses")))


def _claim_limit(t: Tables):
    """What a worker takes with a limit of claims: nothing once it holds as many."""
    rows = [C.claim_allocation(t.tasks, caps(t), t.as_of, 17, worker, 2).select(F.lit(worker).alias("worker"), "claim_order", "id") for worker in ("worker-7", "nobody")]
    return rows[0].unionByName(rows[1])


def _fleet(t: Tables):
    """All workers that hold tasks, by number, of different sizes."""
    n = _number("worker_id")
    ids = t.tasks.filter("claimed_by_worker_id is not null").select(F.col("claimed_by_worker_id").alias("worker_id")).distinct()
    return ids.select("worker_id", n.alias("worker_order"), (n % 5 * 40 + 2).cast("int").alias("processes"), (n % 3 * 30).cast("int").alias("prefetch"), F.when(n % 7 == 0, 3).otherwise(0).alias("max_claimed"))


def _budgets(t: Tables):
    """Budgets of one worker by mode: strict, with prefetching, with a limit of claims, under a cap of the cluster."""
    modes = {"strict": {"processes": 90}, "prefetch": {"processes": 40, "prefetch": 50}, "limited": {"processes": 90, "max_claimed": 1}, "capped": {"processes": 90, "cluster_cap": 100000}, "full": {"processes": 90, "cluster_cap": 5}}
    rows = [C.claim_budget(t.tasks, t.as_of, "worker-7", **kw).select(F.lit(mode).alias("mode"), "budget") for mode, kw in modes.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), rows)


# ---- oracles ---------------------------------------------------------------

_FT = f", ft as (select *, status = 'CLAIMED' as claimed, case when status = 'CLAIMED' then enqueued_at end as claimed_at, enqueued_at as updated_at from tasks)"
_HAD = f"""case {_N} % 5 when 0 then '{{"ok":1}}' when 1 then '{{"err":{{"error_code":"X"}}}}' when 2 then '{{"o' end"""
_STALE = f"t.status = 'RUNNING' and t.started_at is not null and coalesce(hb.last_heartbeat, t.started_at) < {NOW} - interval 300 second"
_HBJ = f"left join {_HB.format('runner')} hb on hb.task_id = t.id"
_AT = f"({NOW} + interval 100 second)"
_OPT = f", o as (select t.*, cast(regexp_extract(task_name, '([0-9]+)$', 1) as int) % 3 as kind, {_N} % 9 as out, {_N} % 3 = 0 as has from ft t), p as (select *, cast(case kind when 0 then case when retry_count >= 1 then 20 else 10 end when 1 then 30 * pow(2, retry_count) end as bigint) as delay from o)"
_CAN = f"kind < 2 and retry_count < max_retries and coalesce(good_until > {NOW}, true) and (good_until is null or {NOW} + to_seconds(delay) < good_until)"
_VERDICTS = """, st as (select n.workflow_id, n.task_index, n.id, n.status, n.join_type, n.min_success, n.allow_failed_deps, len(n.dependencies) as size, w.status = 'RUNNING' {hot} as live from {nodes} n left join {flows} w on w.id = n.workflow_id),
fx as (
  select workflow_id, task_index, id, status, null::varchar as was from st where task_index = 0
  union all
  select s.workflow_id, s.task_index, s.id, case when s.status <> 'PENDING' or not coalesce(s.live, false) then s.status
    when s.join_type = 'any' and c.t = s.size and c.c = 0 then 'SKIPPED' when s.join_type = 'quorum' and c.c + s.size - c.t < c.need then 'SKIPPED'
    when s.join_type = 'all' and c.t = s.size then case when c.t - c.c > 0 and not s.allow_failed_deps then 'SKIPPED' else 'READY' end
    when s.join_type = 'any' and c.c >= 1 then 'READY' when s.join_type = 'quorum' and c.c >= c.need then 'READY' else 'PENDING' end, f.status
  from fx f join st s on s.workflow_id = f.workflow_id and s.task_index = f.task_index + 1,
    lateral (select (f.status = 'COMPLETED')::int + (s.size = 2 and f.was = 'COMPLETED')::int as c, (f.status in ('COMPLETED', 'FAILED', 'SKIPPED'))::int + (s.size = 2 and f.was in ('COMPLETED', 'FAILED', 'SKIPPED'))::int as t, greatest(coalesce(s.min_success, 1), 1) as need) c
)"""
_FIRST = "(select workflow_id, result from {n} where status = 'FAILED' qualify row_number() over (partition by workflow_id order by task_index) = 1)"


def _ended_flows(nodes: str, flows: str, hot: str = "", keep: bool = False) -> str:
    """CTEs: the workflows `flows` after completion over `nodes`, as `cf`."""
    error = "coalesce(error, new_error)" if keep else "coalesce(new_error, error)"
    return f""", ws as (select id, unnest(cast(json_extract(success_policy, '$.cases[*].required_indices') as int[][])) as need from {flows} where success_policy is not null),
wm as (select r.id, bool_or(len(need) > 0 and (select count(distinct n.task_index) from {nodes} n where n.workflow_id = r.id and n.status = 'COMPLETED' and list_contains(r.need, n.task_index)) = len(need)) as met from ws r group by r.id),
wc as (select workflow_id, count(*) filter (status not in {_ENDED}) as open, count(*) filter (status = 'FAILED') as failed from {nodes} group by 1),
wu as (select distinct workflow_id, unnest(dependencies) as task_index from {nodes}),
wr as (select w.id, coalesce(nullif(n.result, ''), 'null') as result from {flows} w left join {nodes} n on n.workflow_id = w.id and n.task_index = w.output_task_index where w.output_task_index is not null
  union all select w.id, {X.value("string_agg(concat(to_json(n.node_id), ':', coalesce(" + X.canonical("n.result") + ", 'null')), ',' order by n.node_id)")} from {flows} w join {nodes} n on n.workflow_id = w.id
  where w.output_task_index is null and not exists (select 1 from wu u where u.workflow_id = n.workflow_id and u.task_index = n.task_index) group by 1),
wq as (select n.workflow_id, n.result from {nodes} n join {flows} w on w.id = n.workflow_id and w.success_policy is not null where n.status = 'FAILED' and n.task_index in (0, 1, 2) qualify row_number() over (partition by n.workflow_id order by n.task_index) = 1),
wv as (select w.*, w.status = 'RUNNING' and w.completed_at is null and coalesce(c.open, 0) = 0 {hot} as go, case when w.success_policy is null then w.error is null and coalesce(c.failed, 0) = 0 else coalesce(m.met, false) end as fine, coalesce(wr.result, {X.value("''")}) as new_result,
  case when w.success_policy is null then {X.error_of("f.result")} else coalesce({X.error_of("q.result")}, {X.CASE_NOT_MET}) end as new_error
  from {flows} w left join wc c on c.workflow_id = w.id left join wm m using (id) left join wr using (id) left join {_FIRST.format(n=nodes)} f on f.workflow_id = w.id left join wq q on q.workflow_id = w.id),
cf as (select id, case when go then case when fine then 'COMPLETED' else 'FAILED' end else status end as status, case when go then new_result else result end as result, case when go and not fine then {error} else error end as error,
  case when go then {NOW} else completed_at end as completed_at, case when go then {NOW} else updated_at end as updated_at, go as changed from wv)"""


_WF0 = ", wf as (select *, null::varchar as result, null::varchar as error from workflows)"
_OUTS = f", oc as (select id as task_id, {_N} % 9 = 0 as ok, case when {_N} % 9 = 6 then null when {_N} % 9 = 0 then '{{\"ok\":1}}' else '{{\"err\":2}}' end as result from tasks where {_N} % 3 = 0)"


def _progress(results: str, nodes: str, flows: str, touched: str = "", keep: bool = False) -> str:
    """CTEs: nodes and workflows after `results` (workflow_id, task_index, k, outcome, summary) over `nodes`, in the workflows that these or `touched` name; pn, cf."""
    hot = "and w.id in (select workflow_id from hot)"
    return f""", rs as ({results}), hot as (select workflow_id from rs {touched}), e1 as (select n.* replace (case when r.k is not null and n.status not in {_ENDED} then r.k else n.status end as status, case when r.k is not null and n.status not in {_ENDED} then r.outcome else n.result end as result), coalesce(r.k = 'FAILED', false) and n.status not in {_ENDED} as fresh
  from {nodes} n left join rs r on r.workflow_id = n.workflow_id and r.task_index = n.task_index),
er as (select workflow_id, {X.error_of("result")} as result from e1 where fresh qualify row_number() over (partition by workflow_id order by task_index) = 1),
f1 as (select w.* replace (case when w.status = 'RUNNING' and e.workflow_id is not null and w.on_error = 'pause' then 'PAUSED' else w.status end as status, case when w.status = 'RUNNING' and e.workflow_id is not null then e.result else w.error end as error) from {flows} w left join er e on e.workflow_id = w.id)
{_VERDICTS.format(nodes="e1", flows="f1", hot=hot)}, pn as (select e.* exclude (fresh) replace (case when fx.status = 'READY' and not e.is_subworkflow and w.status = 'RUNNING' {hot} and (e.status = 'PENDING' or {"e.task_id is null" if keep else "false"}) then 'ENQUEUED' else fx.status end as status) from e1 e join fx using (id) left join f1 w on w.id = e.workflow_id)""" + _ended_flows("pn", "f1", hot, keep)


_BOTH = " select 'workflow' as kind, id, status, result, error from cf union all select 'node', id, status, result, null from pn"


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


_CHILD = f"(select concat(n.workflow_id, '/', n.task_index) as id, w.name, n.workflow_id, n.task_index, w.depth + 1 as depth, w.root_workflow_id from workflow_tasks n join workflows w on w.id = n.workflow_id where n.status = 'ENQUEUED' and n.is_subworkflow)"
_CODE = "case when r = 2 then 'WORKER_CRASHED' when t.status = 'CANCELLED' then 'TASK_CANCELLED' when t.status = 'EXPIRED' then 'TASK_EXPIRED' when t.status = 'COMPLETED' then 'RESULT_NOT_AVAILABLE' else 'WORKER_CRASHED' end"
_SAY = "case when r = 2 then 'Stored task result is corrupt and could not be deserialized' when t.status = 'CANCELLED' then 'Task was cancelled before producing a result' when t.status = 'EXPIRED' then 'Task expired before execution started (good_until passed)' when t.status = 'COMPLETED' then 'Task completed but result is missing' else concat('Worker crashed during task execution (task_status=', t.status, ', no result stored)') end"
_MADE = X.failed(X.error(_CODE, _SAY, """concat('{"task_id":"', n.task_id, '","task_status":"', t.status, '","recovery":"case_1_7"}')"""))
_CRASHED = f"""select n.workflow_id, n.task_index, case when r = 0 then 'COMPLETED' else 'FAILED' end as k, case when r = 0 then '{{"__task_result__":true,"ok":1,"err":null}}' when r = 1 then {X.failed("""'{"__task_error__":true,"error_code":"X","data":null,"message":null}'""")} else {_MADE} end as outcome, null::varchar as summary
from workflow_tasks n join (select *, {_N} % 5 as r from tasks) t on t.id = n.task_id join workflows w on w.id = n.workflow_id where n.status not in {_ENDED} and not n.is_subworkflow and w.status = 'RUNNING' and t.status in ('COMPLETED', 'FAILED', 'CANCELLED', 'EXPIRED')"""
#: In these tables all ended children of running parents are COMPLETED, without a result.
_DONE_CHILDREN = f"""select c.parent_workflow_id as workflow_id, c.parent_task_index as task_index, 'COMPLETED' as k, null as outcome, '' as summary
from workflows c join workflows p on p.id = c.parent_workflow_id and p.status = 'RUNNING' join workflow_tasks n on n.workflow_id = p.id and n.task_index = c.parent_task_index and n.status = 'RUNNING' where c.status in {_WF_ENDED}"""
_STUCK = f"""union all select n.workflow_id from n0 n join workflows w on w.id = n.workflow_id and w.status = 'RUNNING' where n.status = 'PENDING' and not exists (select 1 from n0 d where d.workflow_id = n.workflow_id and list_contains(n.dependencies, d.task_index) and d.status not in {_ENDED})
union all select l.workflow_id from l0 l join workflows w on w.id = l.workflow_id and w.status = 'RUNNING' where l.status = 'READY' and (l.is_subworkflow or l.task_id is null)
union all select w.id from workflows w where w.status = 'RUNNING' and not exists (select 1 from n0 x where x.workflow_id = w.id and x.status not in {_ENDED})"""
_HOT = "and w.id in (select workflow_id from hot)"
_SN = "cast(regexp_extract(schedule_name, '([0-9]+)$', 1) as bigint)"
_DUE = f"(next_run_at is null or next_run_at <= {NOW})"
_THREE = f"(date_trunc('day', {{0}}) + case when {{0}} < date_trunc('day', {{0}}) + interval 3 hour then interval 3 hour else interval 27 hour end)"

_TOLD = X.failed(X.error("'TASK_EXPIRED'", "'Task expired: good_until deadline passed before execution started'", """concat('{"task_id":"', id, '","worker_id":"', claimed_by_worker_id, '"}')"""))
#: Tasks after a round of the reaper, with more columns.
REAPED = oracle(f"{_FT}{_OPT}, x as (select t.*, coalesce({_STALE}, false) as stale, coalesce({_CAN}, false) as can, coalesce(status = 'PENDING' and good_until <= {NOW}, false) as late, coalesce(status = 'CLAIMED' and coalesce(cl.last_heartbeat, claimed_at) < {NOW} - interval 120 second, false) as silent from p t {_HBJ} left join {_HB.format('claimer')} cl on cl.task_id = t.id) select id, case when late then 'EXPIRED' when silent or stale and can then 'PENDING' when stale then 'FAILED' else status end as status, case when stale and can then retry_count + 1 else retry_count end as retry_count, case when silent or stale and can then null else claimed_by_worker_id end as claimed_by_worker_id, case when late then 'TASK_EXPIRED' when stale and can then null when stale then 'WORKER_CRASHED' else error_code end as error_code@@ from x", "tasks", "heartbeats").replace("{", "{{").replace("}", "}}").replace("@@", "{more}")
ORACLES = {
    "schedule_retry": oracle(f"{_FT}, x as (select *, status = 'RUNNING' and {_N} % 2 = 0 and (good_until is null or {_AT} < good_until) as go from ft) select id, case when go then 'PENDING' else status end as status, case when go then retry_count + 1 else retry_count end as retry_count, case when go then {_AT} else next_retry_at end as next_retry_at, case when go then {_AT} else enqueued_at end as enqueued_at, case when go then null else error_code end as error_code, case when go then {NOW} else updated_at end as updated_at, go as changed from x", "tasks"),
    "schedule_stale_retry": oracle(f"{_FT}, x as (select t.*, coalesce({_STALE}, false) and {_N} % 2 = 0 and (good_until is null or {_AT} < good_until) as go from ft t {_HBJ}) select id, case when go then 'PENDING' else status end as status, case when go then retry_count + 1 else retry_count end as retry_count, case when go then {_AT} else next_retry_at end as next_retry_at, case when go then {_AT} else enqueued_at end as enqueued_at, case when go then null else error_code end as error_code, case when go then {NOW} else updated_at end as updated_at, go as changed, case when go then false else claimed end as claimed, case when go then null else claimed_at end as claimed_at, case when go then null else claimed_by_worker_id end as claimed_by_worker_id, case when go then null else claim_expires_at end as claim_expires_at from x", "tasks", "heartbeats"),
    "settle_stale": oracle(f"{_FT}{_OPT}, x as (select t.*, {NOW} + to_seconds(delay) as again, coalesce({_STALE}, false) as stale, coalesce({_CAN}, false) as can from p t {_HBJ}) select id, case when stale and can then 'PENDING' when stale then 'FAILED' else status end as status, case when stale and can then retry_count + 1 else retry_count end as retry_count, case when stale and can then again else next_retry_at end as next_retry_at, case when stale and can then again else enqueued_at end as enqueued_at, case when stale and can then null when stale then 'WORKER_CRASHED' else error_code end as error_code, case when stale then {NOW} else updated_at end as updated_at, stale as changed, case when stale and not can then {NOW} else failed_at end as failed_at, case when stale and not can then '{REASON}' end as failed_reason, case when stale and not can then {CRASHED} else {_HAD} end as result from x", "tasks", "heartbeats"),
    "stale_attempts": oracle(f"{_FT}{_OPT}, x as (select t.*, coalesce({_STALE}, false) as stale, coalesce({_CAN}, false) as can from p t {_HBJ}) select id as task_id, retry_count + 1 as attempt, 'FAILED' as outcome, can as will_retry, started_at, {NOW} as finished_at, 'WORKER_CRASHED' as error_code, '{REASON}' as error_message, '{REASON}' as failed_reason, claimed_by_worker_id as worker_id, worker_hostname, worker_pid from x where stale", "tasks", "heartbeats"),
    "finalize_or_retry": oracle(f"""{_FT}{_OPT}, x as (select *, {NOW} + to_seconds(delay) as again, has and status = 'RUNNING' as own, coalesce(has and status = 'RUNNING' and out = 3 and kind = 0 and {_CAN}, false) as re, case {_N} % 5 when 0 then '{{"ok":1}}' when 1 then '{{"err":{{"error_code":"X"}}}}' when 2 then '{{"o' end as had from p)
select id, case when re then 'PENDING' when own then case when out = 0 then 'COMPLETED' else 'FAILED' end else status end as status, case when re then retry_count + 1 else retry_count end as retry_count, case when re then again else next_retry_at end as next_retry_at, case when re then again else enqueued_at end as enqueued_at,
case when re then null when own then case when out = 3 then 'TASK_EXCEPTION' end else error_code end as error_code, case when own then {NOW} else updated_at end as updated_at, own as changed, case when re or not own then had when out = 6 then null when out = 0 then '{{"ok":1}}' else '{{"err":2}}' end as result,
case when own and not re and out = 0 then {NOW} else completed_at end as completed_at, case when own and not re and out <> 0 then {NOW} else failed_at end as failed_at, case when own and not re and out = 6 then 'worker lost' end as failed_reason from x""", "tasks"),
    "attempts_with_retry": oracle(f"{_FT}{_OPT} select id as task_id, retry_count + 1 as attempt, case out when 0 then 'COMPLETED' when 6 then 'WORKER_FAILURE' else 'FAILED' end as outcome, coalesce(out = 3 and kind = 0 and {_CAN}, false) as will_retry, started_at, {NOW} as finished_at, case when out = 3 then 'TASK_EXCEPTION' end as error_code, claimed_by_worker_id as worker_id from p where has and status = 'RUNNING'", "tasks"),
    "unclaim": oracle(f"{_FT}, x as (select *, coalesce({_N} % 3 = 0 and status = 'CLAIMED' and claimed_by_worker_id = 'worker-7', false) as go from ft) select id, case when go then 'PENDING' else status end as status, case when go then {NOW} else updated_at end as updated_at, go as changed, case when go then false else claimed end as claimed, case when go then null else claimed_at end as claimed_at, case when go then null else claimed_by_worker_id end as claimed_by_worker_id, case when go then null else claim_expires_at end as claim_expires_at from x", "tasks"),
    "expire_claimed": oracle(f"{_FT}, x as (select *, coalesce(status = 'CLAIMED' and claimed_by_worker_id = 'worker-7' and good_until <= {NOW}, false) as go from ft) select id, case when go then 'EXPIRED' else status end as status, case when go then 'TASK_EXPIRED' else error_code end as error_code, case when go then {_TOLD} end as result, case when go then {NOW} else failed_at end as failed_at, case when go then {NOW} else updated_at end as updated_at, go as changed, case when go then false else claimed end as claimed, claimed_at, claimed_by_worker_id, case when go then null else claim_expires_at end as claim_expires_at from x", "tasks"),
    "reset_nodes": oracle(", x as (select *, status = 'ENQUEUED' and task_index % 2 = 0 as go from workflow_tasks) select id, case when go then 'READY' else status end as status, case when go then null else task_id end as task_id, null::timestamp as started_at, go as changed from x", "workflow_tasks"),
    "skip_nodes": oracle(f", x as (select *, status in ('PENDING', 'READY', 'ENQUEUED') and task_index % 2 = 0 as go from workflow_tasks) select id, case when go then 'SKIPPED' else status end as status, case when go then {NOW} end as completed_at, go as changed from x", "workflow_tasks"),
    "guard_nodes": oracle(f", x as (select n.*, coalesce(t.status = 'CLAIMED' and w.status = 'PAUSED', false) as back, coalesce(t.status = 'CLAIMED' and w.status = 'CANCELLED' and n.status in ('PENDING', 'READY', 'ENQUEUED'), false) as off from workflow_tasks n left join tasks t on t.id = n.task_id left join workflows w on w.id = n.workflow_id) select id, case when back then 'READY' when off then 'SKIPPED' else status end as status, case when back then null else task_id end as task_id, case when off then {NOW} end as completed_at, back or off as changed from x", "workflow_tasks", "tasks", "workflows"),
    "start_nodes": oracle(f", x as (select n.*, coalesce(n.status = 'ENQUEUED' and t.status = 'RUNNING' and w.status = 'RUNNING', false) as go from workflow_tasks n left join tasks t on t.id = n.task_id left join workflows w on w.id = n.workflow_id) select id, case when go then 'RUNNING' else status end as status, case when go then {NOW} end as started_at, go as changed from x", "workflow_tasks", "tasks", "workflows"),
    "mark_ready": oracle(" select id, case when status = 'PENDING' and task_index % 2 = 1 then 'READY' else status end as status, status = 'PENDING' and task_index % 2 = 1 as changed from workflow_tasks", "workflow_tasks"),
    "end_ready_nodes": oracle(f""", x as (select *, status = 'READY' and task_index % 3 = 1 as go from workflow_tasks) select id, case when go then 'FAILED' else status end as status, case when go then '{{"err":1}}' else result end as result, case when go then {NOW} end as completed_at, go as changed from x""", "workflow_tasks"),
    "enqueue_subworkflows": oracle(f", x as (select n.*, coalesce(w.status = 'RUNNING' and n.status = 'READY' and n.is_subworkflow, false) as go from workflow_tasks n left join workflows w on w.id = n.workflow_id) select id, case when go then 'ENQUEUED' else status end as status, case when go then {NOW} end as started_at, go as changed from x", "workflow_tasks", "workflows"),
    "reset_subworkflows": oracle(" select id, case when status = 'READY' and is_subworkflow then 'PENDING' else status end as status, status = 'READY' and is_subworkflow as changed from workflow_tasks", "workflow_tasks"),
    "task_of_workflow": oracle(" select id from tasks where exists (select 1 from workflow_tasks n where n.task_id = tasks.id)", "tasks", "workflow_tasks"),
    "insert_workflows": oracle(f", c as {_CHILD} select id, name, status, depth from workflows union all select id, name, 'RUNNING', depth from c", "workflow_tasks", "workflows"),
    "link_children": oracle(f", c as {_CHILD} select n.id, case when c.id is not null then 'RUNNING' else n.status end as status, c.id as sub_workflow_id, c.id is not null as changed from workflow_tasks n left join c on c.workflow_id = n.workflow_id and c.task_index = n.task_index", "workflow_tasks", "workflows"),
    "expand_children": oracle(f", c as {_CHILD} select concat(id, '/', i) as id, id as workflow_id, cast(i as int) as task_index, concat('n', i) as node_id, case when i = 0 then 'READY' else 'PENDING' end as status, {NOW} as created_at from c, range(3) r(i)", "workflow_tasks", "workflows"),
    "append_snapshots": oracle(f" select id, worker_id, snapshot_at from worker_states union all select -id, worker_id, {NOW} from worker_states", "worker_states"),
    "append_heartbeats": oracle(f" select task_id, sender_id, role, sent_at from heartbeats union all select id, 'worker-7', 'claimer', {NOW} from tasks where status = 'CLAIMED' and claimed_by_worker_id = 'worker-7'", "heartbeats", "tasks"),
    "failure_errors": oracle(f", rq as (select n.workflow_id, n.result from workflow_tasks n join workflows w on w.id = n.workflow_id and w.success_policy is not null where n.status = 'FAILED' and n.task_index in (0, 1, 2) qualify row_number() over (partition by n.workflow_id order by n.task_index) = 1) select w.id, case when success_policy is null then {X.error_of('f.result')} else coalesce({X.error_of('q.result')}, {X.CASE_NOT_MET}) end as error from workflows w left join {_FIRST.format(n='workflow_tasks')} f on f.workflow_id = w.id left join rq q on q.workflow_id = w.id", "workflows", "workflow_tasks"),
    "apply_completions": oracle(f"{_WF0}{_ended_flows('workflow_tasks', 'wf')} select * from cf", "workflows", "workflow_tasks"),
    "apply_on_error": oracle(f", x as (select w.*, {X.error_of('f.result')} as e, w.status = 'RUNNING' and f.workflow_id is not null as go from workflows w left join {_FIRST.format(n='workflow_tasks')} f on f.workflow_id = w.id) select id, case when go and on_error = 'pause' then 'PAUSED' else status end as status, case when go then e end as error, case when go then {NOW} else updated_at end as updated_at, go as changed from x", "workflows", "workflow_tasks"),
    "nodes_of_tasks": oracle(f"{_OUTS} select workflow_id, task_index, case when ok then 'COMPLETED' else 'FAILED' end as \"to\", o.result as outcome from workflow_tasks n join oc o using (task_id)", "tasks", "workflow_tasks"),
    "complete_nodes": _recursive(oracle(f"{_WF0}{_OUTS}{_progress('select workflow_id, task_index, case when ok then $$COMPLETED$$ else $$FAILED$$ end as k, o.result as outcome, null::varchar as summary from workflow_tasks n join oc o using (task_id)', 'workflow_tasks', 'wf')}{_BOTH}", "tasks", "workflows", "workflow_tasks")),
    "crashed_results": oracle(f', cr as ({_CRASHED}) select workflow_id, task_index, k as "to", outcome from cr', "tasks", "workflows", "workflow_tasks"),
    "recovery_repair": _recursive(oracle(f"{_WF0}, l0 as (select * replace (case when status = 'READY' and task_index % 2 = 1 then null else task_id end as task_id) from workflow_tasks), n0 as (select n.* replace (case when n.status = 'READY' and n.is_subworkflow and w.status = 'RUNNING' then 'PENDING' else n.status end as status) from l0 n left join workflows w on w.id = n.workflow_id){_progress(f'select * from (({_CRASHED.replace("from workflow_tasks n", "from l0 n")}) union all ({_DONE_CHILDREN})) qualify row_number() over (partition by workflow_id, task_index order by k, outcome) = 1', 'n0', 'wf', _STUCK, True)}{_BOTH}", "tasks", "workflows", "workflow_tasks")),
    "resume_cascade": oracle(""", w as (select * replace (case when status = 'COMPLETED' then 'PAUSED' else status end as status) from workflows),
hit as (select id from w where parent_workflow_id is null and status = 'PAUSED' union select c.id from w c join w p on p.id = c.parent_workflow_id and p.parent_workflow_id is null and p.status = 'PAUSED' where c.status = 'PAUSED')
select id, case when id in (select id from hit) then 'RUNNING' else status end as status, id in (select id from hit) as changed from w""", "workflows"),
    "resume_all": _recursive(oracle(f"{_WF0}, hot as (select id as workflow_id from wf where status = 'PAUSED'), f0 as (select * replace (case when status = 'PAUSED' then 'RUNNING' else status end as status) from wf){_VERDICTS.format(nodes='workflow_tasks', flows='f0', hot=_HOT)}, pn as (select n.* replace (case when fx.status = 'READY' and not n.is_subworkflow and w.status = 'RUNNING' {_HOT} then 'ENQUEUED' else fx.status end as status) from workflow_tasks n join fx using (id) left join f0 w on w.id = n.workflow_id){_ended_flows('pn', 'f0', _HOT)}{_BOTH}", "workflows", "workflow_tasks")),
    "reaper_round": REAPED.format(more=", late or silent or stale as changed"),
    "claim_limit": oracle(f"{_ALLOC} select w.worker, cast(claim_order as int) as claim_order, id from alloc, (values ('worker-7'), ('nobody')) w(worker) where (select count(*) from tasks where {_ACTIVE} and claimed_by_worker_id = w.worker) < 2", "tasks"),
    "claim_budget": oracle(f", c as (select count(*) filter (claimed_by_worker_id = 'worker-7' and (status = 'RUNNING' or {_ACTIVE})) as strict, count(*) filter (claimed_by_worker_id = 'worker-7' and status = 'RUNNING') as soft, count(*) filter (claimed_by_worker_id = 'worker-7' and {_ACTIVE}) as held, count(*) filter (status = 'RUNNING' or {_ACTIVE}) as total from tasks), m(mode, cap, pre, lim, wide) as (values ('strict', 90, false, 90, null), ('prefetch', 90, true, 90, null), ('limited', 90, false, 1, null), ('capped', 90, false, 90, 100000), ('full', 90, false, 90, 5)) select mode, cast(case when held >= lim then 0 else least(greatest(0, cap - case when pre then soft else strict end), greatest(0, coalesce(wide - total, 1000000))) end as bigint) as budget from c, m", "tasks"),
    "delayed_messages": oracle(f" select concat('task_queue_', queue_name) as channel, id as payload, next_retry_at as deliver_at from tasks where status = 'PENDING' and next_retry_at > {NOW}", "tasks"),
    "upgrade_tasks": oracle(f" select id, case when {_N} % 2 = 0 then enqueued_at else {NOW} end as enqueued_at, 'legacy-pre-sha' as enqueue_sha from tasks", "tasks"),
    "upgrade_attempts": oracle(" select task_id, attempt, false as will_retry, null as worker_id, null as worker_process_name, finished_at as created_at from task_attempts", "task_attempts"),
    "tagged_values": oracle(f" select id, case {_N} % 5 when 0 then 'datetime' when 1 then 'date' when 2 then 'result' when 3 then 'plain' end as kind, case when {_N} % 5 = 0 then enqueued_at end as at, case when {_N} % 5 = 1 then DATE '2024-02-29' end as day, case when {_N} % 5 = 2 then '7' end as ok from tasks", "tasks"),
    "nested_values": oracle(f""", n as (select id, {_N} as n from tasks), f as (select * from n where n % 7 <> 0) select id, '$' as path, null as kind, null as value, true as damaged from n where n % 7 = 0
union all select id, '$.a[0]', 'plain', '1', false from f union all select id, '$.a[1]', 'datetime', '2024-01-31T00:00:00+00:00', false from f
union all select id, '$.a[2].b', 'date', case when n % 5 = 0 then '2024-13-01' else '2024-02-29' end, n % 5 = 0 from f union all select id, '$.c.ok.d[0]', 'plain', '"x"', false from f
union all select id, '$.c.ok.d[1]', 'plain', n::varchar, false from f union all select id, '$.e.__future__', 'plain', 'true', false from f union all select id, '$.e.value', 'plain', '"y"', false from f
union all select id, '$.f', 'plain', '{{}}', false from f union all select id, '$.g.__date__', 'plain', 'false', false from f""", "tasks"),
    "node_results": oracle(" select workflow_id, node_id, result from workflow_tasks where result is not null", "workflow_tasks"),
    "node_result": oracle(" select workflow_id, node_id, result from workflow_tasks where result is not null and node_id = 'n1'", "workflow_tasks"),
    "workflow_outcome": oracle(f"{_WF0}{_ended_flows('workflow_tasks', 'wf')} select id, result, error from cf where status in ('COMPLETED', 'FAILED')", "workflows", "workflow_tasks"),
    "node_summaries": oracle(""", e as (select distinct workflow_id, task_index, unnest(dependencies) as dep from workflow_tasks) select e.workflow_id, e.task_index, n.node_id, concat('{"total":', n.task_index, '}') as summary from e join workflow_tasks n on n.workflow_id = e.workflow_id and n.task_index = e.dep and n.is_subworkflow""", "workflow_tasks"),
    "node_config": oracle(" select n.workflow_id, n.task_index, n.status, n.join_type, n.min_success, n.allow_failed_deps, n.is_subworkflow, w.status as workflow_status, w.depth, w.root_workflow_id from workflow_tasks n join workflows w on w.id = n.workflow_id", "workflow_tasks", "workflows"),
    "pending_nodes": oracle(" select workflow_id, task_index, dependencies from workflow_tasks where status = 'PENDING'", "workflow_tasks"),
    "ready_nodes": oracle(" select workflow_id, task_index, dependencies, is_subworkflow from workflow_tasks where status = 'READY'", "workflow_tasks"),
    "paused_children": oracle(" select id, parent_workflow_id, depth, root_workflow_id from workflows where status in ('PAUSED', 'COMPLETED') and parent_workflow_id is not null", "workflows"),
    "task_notifications": oracle(f", late as (select id from tasks where status = 'PENDING' and good_until <= {NOW}) select 'task_status' as channel, id as payload from late union all select 'task_done', id from late union all select unnest(['task_status', 'task_new', concat('task_queue_', queue_name)]), concat(id, '-new') from tasks", "tasks"),
    "workflow_notifications": oracle(" select unnest(['workflow_status', 'workflow_done']) as channel, id as payload from workflows where status = 'RUNNING'", "workflows"),
    "workflow_statuses": oracle(" select count(*) as total, count(*) filter (status = 'PENDING') as pending, count(*) filter (status = 'RUNNING') as running, count(*) filter (status = 'COMPLETED') as completed, count(*) filter (status = 'FAILED') as failed, count(*) filter (status = 'PAUSED') as paused, count(*) filter (status = 'CANCELLED') as cancelled from workflows", "workflows"),
    "retention_attempts": oracle(f", gone as (select id from tasks t where status in ('COMPLETED', 'FAILED', 'CANCELLED', 'EXPIRED') and coalesce(completed_at, failed_at, enqueued_at) < {NOW} - interval 1 day and not exists (select 1 from workflow_tasks n join workflows w on w.id = n.workflow_id where n.task_id = t.id and w.status not in {_WF_ENDED})) select task_id, attempt, outcome from task_attempts where task_id in (select id from tasks) and task_id not in (select id from gone)", "tasks", "task_attempts", "workflow_tasks", "workflows"),
    "schedule_tick": oracle(f" select schedule_name, case when {_DUE} then {NOW} else last_run_at end as last_run_at, case when {_DUE} then {_THREE.format(NOW)} else next_run_at end as next_run_at, run_count + cast({_DUE} as int) as run_count, case when {_DUE} then {NOW} end as updated_at, cast({_DUE} as int) as n_slots from schedule_state", "schedule_state"),
    "schedule_catch_up": oracle(f""", f as (select *, coalesce(next_run_at, {NOW}) as first, {_DUE} as due, {_SN} % 3 as done from schedule_state), r as (select schedule_name, due, done, first as slot from f where due union all select schedule_name, due, done, date_trunc('day', first) + to_days(cast(i as int)) + interval 3 hour from f, range(40) r(i) where due and date_trunc('day', first) + to_days(cast(i as int)) + interval 3 hour > first and date_trunc('day', first) + to_days(cast(i as int)) + interval 3 hour <= {NOW}),
k as (select schedule_name, count(*) as n, max(slot) as last from (select *, row_number() over (partition by schedule_name order by slot) as place from r) where place <= 5 and place <= done group by 1)
select schedule_name, case when n is not null then {NOW} else last_run_at end as last_run_at, case when n is not null then {_THREE.format('last')} else next_run_at end as next_run_at, run_count + cast(n is not null as int) as run_count, case when n is not null then {NOW} end as updated_at, cast(coalesce(n, 0) as int) as n_slots from f left join k using (schedule_name)""", "schedule_state"),
    "schedule_sync": oracle(f" select schedule_name, case when {_SN} % 4 = 1 then {NOW} + interval 1 hour else next_run_at end as next_run_at, case when {_SN} % 4 = 1 then 'new' else 'old' end as config_hash, run_count, case when {_SN} % 4 = 1 then {NOW} end as updated_at, last_run_at from schedule_state where {_SN} % 4 <> 0 union all select 'added', {NOW} + interval 1 hour, 'new', 0, {NOW}, null", "schedule_state"),
    "nested_definitions": oracle(f", u as (select concat('d', n) as name, case when n % 7 = 2 then concat('d', n - 2) else concat('d', n + 1) end as uses from (select cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) as n from workflows) where n % 7 < 3 and n <> 0) select distinct a.name from (select * from u where uses <> 'd0') a join (select * from u where uses <> 'd0') b on b.name = a.uses join (select * from u where uses <> 'd0') c on c.name = b.uses where c.uses = a.name", "workflows"),
}
ORACLES["materialise_nodes"] = oracle(f""", e as (select distinct workflow_id, task_index, unnest(dependencies) as dep from workflow_tasks), v as (select e.workflow_id, e.task_index, n.node_id, {X.seen("n.status", "n.result", "n.task_index", "n.workflow_id")} as value, e.dep, n.is_subworkflow
  from e join workflow_tasks n on n.workflow_id = e.workflow_id and n.task_index = e.dep and n.status in {_ENDED}),
p as (select workflow_id, task_index, string_agg(concat('"d', dep, '":{{"{Q.RESULT_TAG}":true,"data":', to_json(value), '}}'), ',' order by concat('d', dep)) as parts, string_agg(concat('"', node_id, '":', to_json(value)), ',' order by node_id) as seen from v where value is not null group by 1, 2),
u as (select e.workflow_id, e.task_index, string_agg(concat('"', n.node_id, '":', to_json(concat('{{"total":', n.task_index, '}}'))), ',' order by n.node_id) as told from e join workflow_tasks n on n.workflow_id = e.workflow_id and n.task_index = e.dep and n.is_subworkflow group by 1, 2),
q as (select n.*, concat('"workflow_id":"', n.workflow_id, '","task_index":', n.task_index, ',"task_name":"fn_', n.task_index % 4, '"') as place from workflow_tasks n where n.status = 'ENQUEUED' and not n.is_subworkflow and not (n.task_index % 3 = 0 and list_contains(n.dependencies, 0))),
m as (select concat(n.workflow_id, '/', n.task_index) as id, concat('fn_', n.task_index % 4) as task_name, 'main' as queue_name, n.task_index + 1 as priority, '[1]' as args,
  concat('{{', concat_ws(',', case when n.task_index % 3 = 0 then '"d0":1' end, parts, case when len(n.dependencies) > 0 then concat('"{Q.CONTEXT}":{{', place, ',"results_by_id":{{', coalesce(seen, ''), '}},"summaries_by_id":{{', coalesce(told, ''), '}}}}') end, concat('"{Q.META}":{{', place, '}}')), '}}') as kwargs,
  case n.task_index % 3 when 0 then '{_POLICY[0]}' when 1 then '{_POLICY[1]}' end as task_options, case when n.task_index % 3 = 1 then TIMESTAMP '2024-02-01 00:00:00' end as good_until, case n.task_index % 3 when 0 then 2 when 1 then 3 else 0 end as max_retries
  from q n left join p on p.workflow_id = n.workflow_id and p.task_index = n.task_index left join u on u.workflow_id = n.workflow_id and u.task_index = n.task_index)
select id, task_name, queue_name, priority, args, kwargs, 'PENDING' as status, {NOW} as sent_at, {NOW} as enqueued_at, {NOW} as created_at, {NOW} as updated_at, false as claimed, 0 as retry_count, max_retries, task_options, good_until,
  sha256(concat('["', task_name, '","', queue_name, '",', priority, ',', to_json(args), ',', to_json(kwargs), ',"2024-01-31T00:00:00.000000+00:00",', case when good_until is null then 'null' else '"2024-02-01T00:00:00.000000+00:00"' end, ',null,', case when task_options is null then 'null' else to_json(task_options) end, ']')) as enqueue_sha from m""", "workflow_tasks")
_ZONE = "case cast({0} % 3 as int) when 0 then 'UTC' when 1 then 'Europe/Berlin' else 'America/New_York' end"
_LOCAL = "((({0}) at time zone 'UTC') at time zone z)"
#: Runs of each schedule after its first slot, for sixty days: candidates are local times.
_RUNS = f""", k as (select *, {_SN} as n, {_ZONE.format(_SN)} as z, coalesce(next_run_at, {NOW}) as first, {_DUE} and {_SN} % 7 <> 3 as due from schedule_state),
l as (select *, date_trunc('day', {_LOCAL.format("first")}) as day, date_trunc('hour', {_LOCAL.format("first")}) as hour from k),
c as (select schedule_name, n, z, first, due, first + to_seconds(5400 * (i + 1)) as run from l, range(0, 1000) r(i) where n % 5 = 0
  union all select schedule_name, n, z, first, due, ((hour + to_hours(cast(i as int)) + interval 20 minute + interval 5 second) at time zone z) at time zone 'UTC' from l, range(0, 1500) r(i) where n % 5 = 1
  union all select schedule_name, n, z, first, due, ((day + to_days(cast(i as int)) + interval 3 hour + interval 30 minute) at time zone z) at time zone 'UTC' from l, range(0, 60) r(i) where n % 5 = 2
  union all select schedule_name, n, z, first, due, ((day + to_days(cast(i as int)) + interval 9 hour + interval 45 minute) at time zone z) at time zone 'UTC' from l, range(0, 60) r(i) where n % 5 = 3 and dayofweek(day + to_days(cast(i as int))) in (2, 5)
  union all select schedule_name, n, z, first, due, ((day + to_days(cast(i as int)) + interval 6 hour) at time zone z) at time zone 'UTC' from l, range(0, 200) r(i) where n % 5 = 4 and day(day + to_days(cast(i as int))) = 31),
s as (select schedule_name, slot from (select schedule_name, slot, row_number() over (partition by schedule_name order by slot) as place, catching from (select schedule_name, first as slot, n % 2 = 0 as catching from k where due union all select schedule_name, run, true from c where due and n % 2 = 0 and run > first and run <= {NOW}))
  where place <= 3),
e as (select schedule_name, max(slot) as last from s group by 1),
after as (select c.schedule_name, min(run) as run from c join e using (schedule_name) where run > case when n % 2 = 0 then e.last else {NOW} end and (n % 5 > 0 or n % 2 = 0) group by 1)"""
_SLOT_HASH = f"sha1(unhex('{ids.NAMESPACE}') || encode(concat(schedule_name, ':', {_ISO})))"
ORACLES["schedule_ticks"] = oracle(f"""{_RUNS}, x as (select k.*, e.last, case when n % 5 = 0 and n % 2 = 1 then {NOW} + to_seconds(5400) else after.run end as run, {_SLOT_HASH.format("e.last")} as h from k left join e using (schedule_name) left join after using (schedule_name))
select schedule_name, case when last is null then last_run_at else {NOW} end as last_run_at, case when last is null then next_run_at else run end as next_run_at, run_count + cast(last is not null as int) as run_count, case when last is not null then {_UUID} end as last_task_id, case when last is not null then {NOW} end as updated_at from x""", "schedule_state")
ORACLES["schedule_runs"] = oracle(f"{_RUNS} select schedule_name, slot, {_UUID} as task_id from (select *, {_SLOT_HASH.format('slot')} as h from s)", "schedule_state")
ORACLES["schedule_hashes"] = oracle(f"""select schedule_name, sha256(concat('{{"pattern":', case cast({_SN} % 5 as int) when 0 then '{{"type":"interval","seconds":5400,"minutes":null,"hours":null,"days":null}}' when 1 then '{{"type":"hourly","minute":20,"second":5}}'
  when 2 then '{{"type":"daily","time":{{"__time__":true,"value":"03:30:00"}}}}' when 3 then '{{"type":"weekly","days":["tuesday","friday"],"time":{{"__time__":true,"value":"09:45:00"}}}}' else '{{"type":"monthly","day":31,"time":{{"__time__":true,"value":"06:00:00"}}}}' end,
  ',"timezone":"', {_ZONE.format(_SN)}, '"}}')) as config_hash from schedule_state""", "schedule_state").replace(")select", ") select")


def _claims(cluster_cap: int | None) -> str:
    """CTEs: tk (worker_id, n, q, start, take) of all workers and queues, and placed tasks."""
    out = f""", queues as (select distinct queue_name, length(queue_name) % 5 + 3 as cap, case when length(queue_name) % 5 = 2 then 2 else 100000 end as lim from tasks),
qs as (select q.*, greatest(0, least(o.n, lim - o.busy)) as there, cast(row_number() over (order by q.queue_name) - 1 as int) as no from queues q join (select queue_name, count(*) filter ({_OPEN}) as n, count(*) filter (status = 'RUNNING' or {_ACTIVE}) as busy from tasks group by 1) o using (queue_name)),
own as (select claimed_by_worker_id as worker_id, count(*) filter (status = 'RUNNING') as running, count(*) filter ({_ACTIVE}) as held from tasks where claimed_by_worker_id is not null group by 1),
fleet as (select worker_id, n, case when held >= case when n % 7 = 0 then 3 else cap end then 0 else greatest(0, cap - running - case when pre = 0 then held else 0 end) end as b0 from (select *, n % 5 * 40 + 2 + n % 3 * 30 as cap, n % 3 * 30 as pre from (select *, cast(regexp_extract(worker_id, '([0-9]+)$', 1) as bigint) as n from own)))"""
    for i in range(5):
        there, cap = (f"coalesce((select {c} from qs where no = {i}), 0)" for c in ("there", "cap"))
        before = f"coalesce(sum(least({cap}, b{i})) over (order by n rows between unbounded preceding and 1 preceding), 0)"
        name = "fleet" if i == 0 else f"w{i - 1}"
        out += f""", v{i} as (select *, least({before}, {there}) as s{i}, least(least({cap}, b{i}), {there} - least({before}, {there})) as t{i} from {name}), w{i} as (select *, b{i} - t{i} as b{i + 1} from v{i})"""
    parts = " union all ".join(f"select worker_id, n, {i} as no, s{i} as start, t{i} as take from w4" for i in range(5))
    room = "take" if cluster_cap is None else f"greatest(0, least(take, {cluster_cap} - (select count(*) from tasks where status = 'RUNNING' or {_ACTIVE}) - coalesce(sum(take) over (order by n, no rows between unbounded preceding and 1 preceding), 0)))"
    return out + f""", tk as (select worker_id, no, start, {room} as take from ({parts})), ranked as (select *, row_number() over (partition by queue_name order by priority, enqueued_at, id) as place from tasks where {_OPEN}),
taken as (select k.worker_id, r.queue_name, cast(r.place as int) as place, r.id from tk k join qs on qs.no = k.no join ranked r on r.queue_name = qs.queue_name and r.place > k.start and r.place <= k.start + k.take)"""


ORACLES["claims_of_workers"] = oracle(f"{_claims(60000)} select * from taken", "tasks")
ORACLES["claim_all"] = oracle(f"{_FT}{_claims(None)} select f.id, case when k.id is not null then 'CLAIMED' else status end as status, case when k.id is not null then {NOW} else updated_at end as updated_at, k.id is not null as changed, f.claimed or k.id is not null as claimed, case when k.id is not null then {NOW} else claimed_at end as claimed_at, coalesce(k.worker_id, claimed_by_worker_id) as claimed_by_worker_id, case when k.id is not null then {NOW} + interval 60 second else claim_expires_at end as claim_expires_at from ft f left join taken k using (id)", "tasks")
ORACLES["dag_fixpoint"] = _recursive(oracle(f"{_VERDICTS.format(nodes='workflow_tasks', flows='workflows', hot='')} select id, status from fx", "workflows", "workflow_tasks"))
ORACLES["advisory_key"] = oracle(" select schedule_name, cast(case when h >= 9223372036854775808 then h - 18446744073709551616 else h end as bigint) as key from (select schedule_name, cast(cast(concat('0x', substr(sha256(schedule_name), 1, 16)) as uhugeint) as hugeint) as h from schedule_state)", "schedule_state")
