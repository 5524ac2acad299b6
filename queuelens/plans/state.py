"""Queries on the state of tasks and workflows, and transitions, by name, with their oracles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from queuelens.functions import ids, retry, schedule
from queuelens.functions.times import ago
from queuelens.operators import claim as C
from queuelens.operators import dag as D
from queuelens.operators import enqueue as Q
from queuelens.operators import health as H
from queuelens.operators import retention as R
from queuelens.operators import transitions as T
from queuelens.plans import resultsql as X
from queuelens.sources.fixtures import oracle
from queuelens.sources.tables import Tables, completed

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
DAY = 24 * 3600
_ENDED = "('COMPLETED', 'FAILED', 'SKIPPED')"
_TASK_ENDED = "('COMPLETED', 'FAILED', 'CANCELLED', 'EXPIRED')"
_WF_ENDED = "('COMPLETED', 'FAILED', 'CANCELLED')"
_HB = "(select task_id, max(sent_at) as last_heartbeat from heartbeats where role = '{}' group by task_id)"
_ACTIVE = f"(status = 'CLAIMED' and (claim_expires_at is null or claim_expires_at > {NOW}))"
_FLIGHT = f"count(*) filter (status = 'RUNNING' or {_ACTIVE}) as in_flight, count(*) filter (status = 'RUNNING') as running, count(*) filter ({_ACTIVE}) as claimed"
_CLAIMABLE = (
    f"(status = 'PENDING' or (status = 'CLAIMED' and claim_expires_at < {NOW})) and enqueued_at <= {NOW} and (next_retry_at is null or next_retry_at <= {NOW}) and (good_until is null or good_until > {NOW})"
)
_RANKED = f"select *, row_number() over (partition by queue_name order by priority, enqueued_at, id) as place from tasks where {_CLAIMABLE}"



def full(t: Tables) -> Tables:
    """The tables with all columns: tasks claimed as they were enqueued, and not updated since."""
    t, claimed = completed(t), F.col("status") == "CLAIMED"
    return replace(t, tasks=t.tasks.withColumns({"claimed": claimed, "claimed_at": F.when(claimed, F.col("enqueued_at")), "updated_at": F.col("enqueued_at")}))


def damaged(t: Tables):
    """Nodes, some of them with results that are no JSON, and some with empty ones."""
    broken = F.when((F.col("status") == "COMPLETED") & (F.col("task_index") % 4 == 3), '{"r":').when((F.col("status") == "FAILED") & (F.col("task_index") % 4 == 2), "").otherwise(F.col("result"))
    return t.workflow_tasks.withColumn("result", broken)


def flawed(t: Tables):
    """Nodes of graphs with planted flaws: unknown dependencies, and cycles of the first two nodes."""
    n = F.regexp_extract("workflow_id", r"(\d+)$", 1).cast("long")
    loop = (n % 13 == 0) & (F.col("task_index") == 0)
    unknown = (n % 11 == 0) & (F.col("task_index") == 1)
    return t.workflow_tasks.withColumn("dependencies", F.when(loop, F.array(F.lit(1))).when(unknown, F.array(F.lit(0), F.lit(99))).otherwise(F.col("dependencies")))


def caps(t: Tables):
    """Caps for the queues of the fixtures, in the order of their names."""
    queues = t.tasks.select("queue_name").distinct()
    n = F.pmod(F.length("queue_name"), F.lit(5))
    return queues.select("queue_name", F.col("queue_name").alias("queue_order"), (n + 3).alias("cap"), F.when(n == 2, F.lit(2)).otherwise(F.lit(100000)).alias("max_concurrency"))


def _finished(t: Tables):
    """Workflows whose children completed or failed, with results and errors of all kinds."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    result, error = F.floor(n / 6) % 4, F.floor(n / 12) % 5
    return t.workflows.withColumns({
        "status": F.when(F.col("parent_workflow_id").isNotNull() & (n % 12 == 7), "FAILED").otherwise(F.col("status")),
        "result": F.when(result == 0, F.concat(F.lit('{"__task_result__":true,"ok":{"r":'), n.cast("string"), F.lit('},"err":null}'))).when(result == 1, F.concat(F.lit('{"ok":'), n.cast("string"), F.lit("}"))).when(result == 2, '{"r'),
        "error": F.when(error == 0, '{"__task_error__":true,"error_code":"E","data":null,"message":"a b"}').when(error == 1, "plain words").when(error == 2, '{"message":3}').when(error == 3, "[1]"),
    })


def _states(df, key: str, *more: str):
    return df.select(key, "status", *more)


def outcomes(t: Tables):
    """Outcomes of a third of the running tasks: success, failure, or loss of the worker."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    running = t.tasks.filter(n % 3 == 0)
    kind = F.pmod(n, F.lit(9))
    return running.select(F.col("id").alias("task_id"), (kind == 0).alias("ok"), F.when(kind != 6, F.lit('{"ok":1}')).alias("result"), F.when(kind == 3, F.lit("TASK_EXCEPTION")).alias("error_code"), F.when(kind == 6, F.lit("worker lost")).alias("failed_reason"))


def _full(t: Tables):
    """Tasks with the columns that transitions set."""
    none = F.lit(None)
    return t.tasks.withColumns({"result": none.cast("string"), "failed_reason": none.cast("string")})


def _options(t: Tables):
    """Tasks with a retry policy by kind of task."""
    n = F.regexp_extract("task_name", r"(\d+)$", 1).cast("int")
    text = F.when(n % 3 == 0, '{"retry_policy":{"intervals":[10,20],"backoff_strategy":"fixed"},"auto_retry_for":["WORKER_CRASHED"]}').when(n % 3 == 1, '{"retry_policy":{"intervals":[30],"backoff_strategy":"exponential"},"auto_retry_for":["WORKER_CRASHED"]}')
    return t.tasks.filter("status = 'RUNNING'").withColumn("options", F.from_json(text, retry.OPTIONS))


def _attempts(t: Tables):
    """Later attempts for tasks with an even number, in place of the second or as a ninth."""
    again = t.task_attempts.filter("attempt = 2").withColumn("outcome", F.lit("FAILED")).withColumn("error_code", F.lit("TASK_EXCEPTION"))
    return T.upsert_attempts(t.task_attempts, again.unionByName(again.withColumn("attempt", F.lit(9))))


def _incoming(t: Tables):
    """Tasks that are sent again, some with other content, and new ones."""
    known = t.tasks.select("id", F.md5("task_name").alias("enqueue_sha"))
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    sent = known.select(F.when(n % 3 == 0, F.concat("id", F.lit("-new"))).otherwise(F.col("id")).alias("id"), F.when(n % 3 == 1, F.col("enqueue_sha")).otherwise(F.md5("id")).alias("enqueue_sha"))
    return T.enqueue(known, sent).select("id", "verdict")


def _cancelled(t: Tables):
    flows, nodes, tasks = T.cancel_workflows(t.workflows, t.workflow_tasks, t.tasks, F.col("status").isin("RUNNING", "PAUSED"), t.as_of)
    rows = [flows.select(F.lit("workflow").alias("kind"), "id", "status"), nodes.select(F.lit("node").alias("kind"), "id", "status"), tasks.select(F.lit("task").alias("kind"), "id", "status")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _next(pattern: schedule.Pattern, tz: str):
    return lambda t: t.schedule_state.select("schedule_name", schedule.next_run(pattern, F.col("last_run_at"), tz).alias("next_run"))


def _fingerprint(t: Tables):
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    text = ids.json_text
    value = ids.fingerprint(text(F.col("task_name")), text(F.col("queue_name")), number("priority"), F.lit("null"), F.lit("null"), text(ids.canonical(F.col("enqueued_at"))), text(ids.canonical(F.col("good_until"))), F.lit("null"), F.lit("null"))
    return t.tasks.select("id", value.alias("enqueue_sha"))


def _argued(t: Tables):
    """Nodes with arguments of their own, one of them also injected for every seventh workflow."""
    deps = F.transform("dependencies", lambda i: F.concat(F.lit("d"), i.cast("string")))
    n = F.regexp_extract("workflow_id", r"(\d+)$", 1).cast("long")
    return damaged(t).withColumns({"args_from": F.map_from_arrays(deps, "dependencies"), "task_kwargs": F.when(n % 7 == 0, '{"d0": 1}').when(n % 2 == 0, '{"x": [1, "a"]}')})


def _asking(t: Tables):
    return damaged(t).withColumn("workflow_ctx_from", F.transform("dependencies", lambda i: F.concat(F.lit("n"), i.cast("string"))))


QUERIES = {
    # health and claims
    "stale_tasks": lambda t: H.stale_tasks(t.tasks, t.heartbeats, t.as_of, 300),
    "worker_stats": lambda t: H.worker_stats(t.tasks, t.heartbeats),
    "expired_tasks": lambda t: H.expired_tasks(t.tasks, t.as_of),
    "stale_claimed": lambda t: H.stale_claimed(t.tasks, t.heartbeats, t.as_of, 120, "enqueued_at"),
    "in_flight_global": lambda t: H.load_counts(t.tasks, t.as_of),
    "in_flight_queue": lambda t: H.load_counts(t.tasks, t.as_of, "queue_name"),
    "in_flight_worker": lambda t: H.load_counts(t.tasks, t.as_of, "claimed_by_worker_id"),
    "claimable_top_k": lambda t: C.claimable_top_k(t.tasks, t.as_of, 10),
    "claim_allocation": lambda t: C.claim_allocation(t.tasks, caps(t), t.as_of, 17),
    "claim_tasks": lambda t: _states(C.claim(t.tasks, C.claim_allocation(t.tasks, caps(t), t.as_of, 17), t.as_of, "worker-x").filter("changed"), "id", "claimed_by_worker_id", "claim_expires_at"),
    "nonrunnable_tasks": lambda t: H.nonrunnable_tasks(t.tasks, t.workflow_tasks, t.workflows),
    "guard_workflows": lambda t: _states(C.guard_workflows(t.tasks, t.workflow_tasks, t.workflows, t.as_of), "id", "claimed_by_worker_id"),
    # graphs
    "dag_edges": lambda t: D.edges(t.workflow_tasks),
    "dep_status_counts": lambda t: D.dep_status_counts(t.workflow_tasks),
    "join_readiness_round1": lambda t: D.verdicts(t.workflow_tasks, t.workflows),
    "dag_fixpoint": lambda t: D.propagate(t.workflow_tasks, t.workflows).select("id", "status"),
    "dag_sinks": lambda t: D.sinks(t.workflow_tasks),
    "dependents": lambda t: D.dependents(t.workflow_tasks, t.workflow_tasks.filter("status = 'COMPLETED'")),
    "dependency_results": lambda t: D.dependency_results(damaged(t)).select("workflow_id", "task_index", F.explode("results").alias("dep", "result")),
    "child_summary": lambda t: D.child_summary(_finished(t), t.workflow_tasks),
    "completion_status": lambda t: D.completion_status(t.workflows, t.workflow_tasks),
    "success_policy": lambda t: D.success(t.workflows, t.workflow_tasks),
    "first_failed": lambda t: D.first_failed(t.workflow_tasks),
    "first_failed_required": lambda t: D.first_failed(t.workflow_tasks, t.workflows),
    "final_results": lambda t: D.final_results(t.workflows, t.workflow_tasks),
    "completions": lambda t: D.completions(t.workflows, t.workflow_tasks),
    "on_error": lambda t: D.on_error(t.workflows, t.workflow_tasks),
    "invalid_graphs": lambda t: D.invalid_graphs(flawed(t), t.workflows),
    "ctx_ready": lambda t: D.ctx_ready(_asking(t)),
    "node_context": lambda t: Q.context(_asking(t)).select("workflow_id", "task_index", F.explode("results").alias("node_id", "result")),
    "results_with_names": lambda t: Q.results_with_names(damaged(t).withColumn("task_name", F.col("join_type")), t.workflow_tasks.filter("task_index <> 5")),
    "node_arguments": lambda t: Q.arguments(_argued(t)),
    "tasks_of_nodes": lambda t: Q.tasks_of(t.workflow_tasks, t.as_of),
    "link_tasks": lambda t: Q.link(t.workflow_tasks, Q.tasks_of(t.workflow_tasks, t.as_of)).select("id", "task_id"),
    "children_of_nodes": lambda t: Q.children_of(t.workflow_tasks, t.workflows, t.as_of),
    "parent_results": lambda t: Q.parent_results(D.child_summary(_finished(t), t.workflow_tasks)),
    "end_nodes": lambda t: _states(T.end_nodes(full(t).workflow_tasks, Q.parent_results(D.child_summary(_finished(t), t.workflow_tasks)), t.as_of), "id", "result", "sub_workflow_summary", "changed"),
    "start_workflow": lambda t: T.start_workflow(t.workflow_tasks, t.as_of).select("id", "status", "created_at"),
    # recovery
    "rec_pending": lambda t: D.rec_pending(t.workflow_tasks, t.workflows),
    "rec_ready": lambda t: D.rec_ready(t.workflow_tasks.withColumn("task_id", F.when(F.col("task_index") % 2 == 0, F.col("task_id"))), t.workflows),
    "rec_ready_sub": lambda t: D.rec_ready(t.workflow_tasks, t.workflows, subworkflows=True),
    "rec_children": lambda t: D.rec_children(t.workflows, t.workflow_tasks),
    "rec_crashed": lambda t: D.rec_crashed(t.workflow_tasks, t.tasks, t.workflows),
    "rec_terminal": lambda t: D.rec_terminal(t.workflows, t.workflow_tasks),
    # transitions
    "expire_pending": lambda t: _states(T.expire_pending(full(t).tasks, t.as_of), "id", "error_code", "result"),
    "requeue_claimed": lambda t: _states(T.requeue_claimed(t.tasks, t.heartbeats, t.as_of, 120, "enqueued_at"), "id", "claimed_by_worker_id"),
    "mark_stale_failed": lambda t: _states(T.mark_stale_failed(full(t).tasks, t.heartbeats, t.as_of), "id", "error_code", "failed_at", "failed_reason", "result"),
    "renew_lease": lambda t: _states(T.renew_leases(t.tasks, t.as_of, "worker-7", 60, 7 * DAY, "enqueued_at"), "id", "claim_expires_at"),
    "start_claimed": lambda t: _states(T.start_claimed(full(t).tasks, H.nonrunnable_tasks(t.tasks, t.workflow_tasks, t.workflows), t.as_of, "worker-1"), "id", "started_at"),
    "finalize_outcomes": lambda t: _states(T.finalize(_full(t), outcomes(t), t.as_of), "id", "result", "error_code", "failed_reason"),
    "attempts_of": lambda t: T.attempts_of(_full(t), outcomes(t), t.as_of),
    "upsert_attempts": lambda t: _attempts(t),
    "enqueue_conflicts": _incoming,
    "retry_plan": lambda t: retry.retry_plan(_options(t), ago(t.as_of, 0), F.col("options"), F.lit("WORKER_CRASHED")).select("id", "verdict", "delay_seconds", "retry_at"),
    "cancel_workflow": _cancelled,
    "pause_cascade": lambda t: T.cascade(t.workflows.withColumn("status", F.when(F.col("status") == "COMPLETED", "RUNNING").otherwise(F.col("status"))), F.col("parent_workflow_id").isNull(), "RUNNING", "PAUSED", t.as_of).select("id", "status", "changed"),
    "resume": lambda t: T.resume(t.workflows, F.lit(True), t.as_of).select("id", "status", "changed"),
    "enqueue_nodes": lambda t: T.enqueue_nodes(t.workflow_tasks, t.workflows, t.as_of).select("id", "status", "changed"),
    "claimer_heartbeats": lambda t: T.claimer_heartbeats(t.tasks, t.as_of, "worker-7", "host-1", 42),
    "change_feed": lambda t: T.changes(t.tasks, T.expire_pending(full(t).tasks, t.as_of), "id"),
    # retention
    "retention_heartbeats": lambda t: R.keep_recent(t.heartbeats, "sent_at", t.as_of, 600),
    "retention_worker_states": lambda t: R.keep_recent(t.worker_states, "snapshot_at", t.as_of, 7 * DAY).select("id", "worker_id", "snapshot_at"),
    "retention_workflows": lambda t: R.keep_workflows(t.workflows, t.as_of, 30 * DAY).select("id", "status"),
    "retention_workflow_tasks": lambda t: R.keep_nodes(t.workflow_tasks, t.workflows, t.as_of, 30 * DAY).select("id", "workflow_id"),
    "retention_tasks": lambda t: R.keep_tasks(t.tasks, t.workflow_tasks, t.workflows, t.as_of, DAY).select("id", "status"),
    # schedules and identifiers
    "due_schedules": lambda t: schedule.due_schedules(t.schedule_state, t.as_of),
    "next_run_interval": _next(schedule.Interval(5400), "UTC"),
    "next_run_hourly": _next(schedule.Hourly(15, 30), "Asia/Kolkata"),
    "next_run_daily": _next(schedule.Daily(2, 30), "America/New_York"),
    "next_run_weekly": _next(schedule.Weekly(("tuesday", "friday"), 9, 45), "Europe/Berlin"),
    "next_run_monthly": _next(schedule.Monthly(31, 6), "UTC"),
    "missed_runs": lambda t: t.schedule_state.select("schedule_name", F.explode(schedule.missed_runs(schedule.Daily(3), F.coalesce("next_run_at", "last_run_at"), t.as_of, 10)).alias("slot")),
    "schedule_slot_id": lambda t: t.schedule_state.select("schedule_name", ids.slot_id(F.col("schedule_name"), F.col("last_run_at")).alias("slot_id")),
    "enqueue_fingerprint": _fingerprint,
}

_COUNTS = f"count(*) filter (not wt.status in {_ENDED}) as incomplete, count(*) filter (wt.status = 'FAILED') as failed, count(*) filter (wt.status = 'COMPLETED') as completed, count(*) as total"
_STALE = f"t.status = 'RUNNING' and t.started_at is not null and coalesce(hb.last_heartbeat, t.started_at) < {NOW} - interval 300 second"
_EDGES = ", edges as (select workflow_id, task_index, unnest(dependencies) as dep from workflow_tasks)"
_WF_N = "cast(regexp_extract(workflow_id, '([0-9]+)$', 1) as bigint)"
#: Nodes with damaged results, and what others see of them.
_DAMAGED = f""", dm as (select * replace (case when status = 'COMPLETED' and task_index % 4 = 3 then '{{"r":' when status = 'FAILED' and task_index % 4 = 2 then '' else result end as result) from workflow_tasks),
dn as (select *, {X.seen("status", "result", "task_index", "workflow_id")} as value from dm)"""
_CAPQ = ", caps as (select distinct queue_name, length(queue_name) % 5 + 3 as cap, case when length(queue_name) % 5 = 2 then 2 else 100000 end as lim from tasks)"
_ALLOC = f"""{_CAPQ}, busy as (select queue_name, count(*) filter (status = 'RUNNING' or {_ACTIVE}) as busy from tasks group by 1),
room as (select c.queue_name, greatest(0, least(cap, lim - coalesce(busy, 0))) as room from caps c left join busy using (queue_name)),
ranked as ({_RANKED}), first as (select queue_name, place, id from ranked join room using (queue_name) where place <= room),
alloc as (select row_number() over (order by queue_name, place) as claim_order, * from first qualify row_number() over (order by queue_name, place) <= 17)"""
_VERDICT = f"""{_EDGES}, counts as (
  select e.workflow_id, e.task_index, count(*) filter (n.status = 'COMPLETED') as c, count(*) filter (n.status = 'FAILED') as f, count(*) filter (n.status = 'SKIPPED') as s
  from (select distinct * from edges) e join workflow_tasks n on n.workflow_id = e.workflow_id and n.task_index = e.dep group by all
), waiting as (
  select w.*, len(dependencies) as size, coalesce(c, 0) as c, coalesce(f, 0) as f, coalesce(s, 0) as s, greatest(coalesce(min_success, 1), 1) as need
  from workflow_tasks w join workflows x on x.id = w.workflow_id and x.status = 'RUNNING' left join counts k on k.workflow_id = w.workflow_id and k.task_index = w.task_index
  where w.status = 'PENDING' and len(dependencies) > 0
) select workflow_id, task_index, case
  when join_type = 'any' and c + f + s = size and c = 0 then 'SKIPPED'
  when join_type = 'quorum' and c + size - (c + f + s) < need then 'SKIPPED'
  when join_type = 'all' and c + f + s = size then case when f + s > 0 and not allow_failed_deps then 'SKIPPED' else 'READY' end
  when join_type = 'any' and c >= 1 then 'READY'
  when join_type = 'quorum' and c >= need then 'READY'
  else 'PENDING' end as verdict from waiting"""
_N = "cast(regexp_extract(id, '([0-9]+)$', 1) as bigint)"
_OUT = f", o as (select id as task_id, {_N} % 9 as kind from tasks where {_N} % 3 = 0)"
_NONRUN = "select t.id, w.status as workflow_status from tasks t join workflow_tasks wt on wt.task_id = t.id join workflows w on w.id = wt.workflow_id where w.status in ('PAUSED', 'CANCELLED')"
_SUCCESS = """, j as (select id, status, completed_at, success_policy, json_extract(success_policy, '$.cases') as cases from workflows),
req as (select id, unnest(cast(json_extract(success_policy, '$.cases[*].required_indices') as int[][])) as need from workflows where success_policy is not null),
met as (select r.id, bool_or(len(need) > 0 and (select count(distinct n.task_index) from workflow_tasks n where n.workflow_id = r.id and n.status = 'COMPLETED' and list_contains(r.need, n.task_index)) = len(need)) as met from req r group by r.id),
fail as (select workflow_id, count(*) filter (status = 'FAILED') as failed from workflow_tasks group by 1),
succ as (select j.id, coalesce(failed, 0) as failed, case when success_policy is not null then coalesce(met, false) end as policy_met,
  case when success_policy is null then coalesce(failed, 0) = 0 else coalesce(met, false) end as succeeded from j left join met using (id) left join fail on workflow_id = j.id)"""


#: Children that completed or failed, with results and errors of all kinds.
_FINISHED = f""", wf as (select * exclude (status), case when parent_workflow_id is not null and {_N} % 12 = 7 then 'FAILED' else status end as status,
  case cast({_N} // 6 % 4 as int) when 0 then concat('{{"__task_result__":true,"ok":{{"r":', {_N}, '}},"err":null}}') when 1 then concat('{{"ok":', {_N}, '}}') when 2 then '{{"r' end as result,
  case cast({_N} // 12 % 5 as int) when 0 then '{{"__task_error__":true,"error_code":"E","data":null,"message":"a b"}}' when 1 then 'plain words' when 2 then '{{"message":3}}' when 3 then '[1]' end as error from workflows)"""
_SAID = f"case when json_valid(error) and error <> 'null' then case when json_type(error) = 'OBJECT' and json_type(error, '$.message') = 'VARCHAR' then {X.member('error', '$.message')} end else to_json(substr(error, 1, 200)) end"
_SUMMARY = f"""concat('{{"status":"', status, '","output":', coalesce({X.member(X.canonical('result'), '$.ok')}, 'null'), ',"total_tasks":', total, ',"completed_tasks":', completed, ',"failed_tasks":', failed, ',"skipped_tasks":', skipped, ',"error_summary":', coalesce(case when error is not null then {_SAID} end, 'null'), '}}')"""
_CHILD_ERROR = """concat('{"__task_result__":true,"ok":null,"err":{"__task_error__":true,"error_code":{"__builtin_task_code__":"SUBWORKFLOW_FAILED"},"data":null,"message":"Subworkflow ', id, ' failed with status ', status, '","sub_workflow_id":"', id, '","sub_workflow_summary":', summary, '}}')"""
_PARENTS = f"""{_FINISHED}, cs as (select w.id, w.parent_workflow_id, w.parent_task_index, w.status, w.result, w.error, count(n.id) as total, count(*) filter (n.status = 'COMPLETED') as completed, count(*) filter (n.status = 'FAILED') as failed, count(*) filter (n.status = 'SKIPPED') as skipped
  from wf w left join workflow_tasks n on n.workflow_id = w.id where w.parent_workflow_id is not null group by all),
pr as (select parent_workflow_id as workflow_id, parent_task_index as task_index, case when status = 'COMPLETED' then 'COMPLETED' else 'FAILED' end as "to", case when status = 'COMPLETED' then result else {_CHILD_ERROR} end as outcome,
  summary from (select *, {_SUMMARY} as summary from cs) where status in {_WF_ENDED})"""


def _local(tz: str, expr: str) -> str:
    """A local time as a naive UTC instant."""
    return f"(({expr}) at time zone '{tz}') at time zone 'UTC'"


def _next_sql(tz: str, candidates: str) -> str:
    """The least candidate after last_run_at; candidates are local times over l (local now)."""
    local = f"((last_run_at at time zone 'UTC') at time zone '{tz}')"
    return oracle(f", s as (select schedule_name, last_run_at, {local} as l from schedule_state) select schedule_name, min(utc) as next_run from (select schedule_name, last_run_at, {_local(tz, 'c')} as utc from ({candidates})) where utc > last_run_at group by 1", "schedule_state")


#: What expired and silent tasks are told.
LATE = X.failed(X.error("'TASK_EXPIRED'", "'Task expired: good_until deadline passed before execution started'"))
REASON = "Worker process crashed (no runner heartbeat for 300000ms = 300.0s)"
_PLAIN_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"
CRASHED = X.failed(X.error("'WORKER_CRASHED'", f"'{REASON}'", f"""concat('{{"stale_threshold_ms":300000,"stale_threshold_seconds":300.0,"worker_pid":', worker_pid, ',"worker_hostname":"', worker_hostname, '","worker_id":', coalesce('"' || claimed_by_worker_id || '"', 'null'), ',"started_at":"', {_PLAIN_ISO.format("started_at")}, '","detected_at":"2024-01-31T00:00:00+00:00"}}')"""))
_UUID = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(h, 18, 3), '-', substr(h, 21, 12))"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f+00:00')"
ORACLES = {
    "stale_tasks": oracle(f" select t.id, t.worker_hostname, t.worker_pid, hb.last_heartbeat, t.started_at, t.task_name, t.retry_count, t.max_retries, t.good_until, t.claimed_by_worker_id from tasks t left join {_HB.format('runner')} hb on hb.task_id = t.id where {_STALE}", "tasks", "heartbeats"),
    "worker_stats": oracle(f" select worker_hostname, worker_pid, count(*) as active_tasks, min(started_at) as oldest_task_start, max(last_heartbeat) as latest_heartbeat from tasks t left join {_HB.format('runner')} hb on hb.task_id = t.id where status = 'RUNNING' and worker_hostname is not null group by 1, 2", "tasks", "heartbeats"),
    "expired_tasks": oracle(f" select id, task_name, queue_name, priority, enqueued_at, good_until, date_diff('second', good_until, {NOW}) as expired_seconds from tasks where status = 'PENDING' and good_until <= {NOW}", "tasks"),
    "stale_claimed": oracle(f" select id, claimed_by_worker_id, last_heartbeat from tasks t left join {_HB.format('claimer')} hb on hb.task_id = t.id where status = 'CLAIMED' and coalesce(last_heartbeat, enqueued_at) < {NOW} - interval 120 second", "tasks", "heartbeats"),
    "in_flight_global": oracle(f" select {_FLIGHT} from tasks", "tasks"),
    "in_flight_queue": oracle(f" select queue_name, {_FLIGHT} from tasks where status in ('RUNNING', 'CLAIMED') group by 1", "tasks"),
    "in_flight_worker": oracle(f" select claimed_by_worker_id, {_FLIGHT} from tasks where status in ('RUNNING', 'CLAIMED') group by 1", "tasks"),
    "claimable_top_k": oracle(f" select queue_name, cast(place as int) as place, id, task_name, priority from ({_RANKED}) where place <= 10", "tasks"),
    "claim_allocation": oracle(f"{_ALLOC} select cast(claim_order as int) as claim_order, queue_name, cast(place as int) as place, id from alloc", "tasks"),
    "claim_tasks": oracle(f"{_ALLOC} select id, 'CLAIMED' as status, 'worker-x' as claimed_by_worker_id, {NOW} + interval 60 second as claim_expires_at from alloc", "tasks"),
    "nonrunnable_tasks": oracle(f" {_NONRUN}", "tasks", "workflow_tasks", "workflows"),
    "guard_workflows": oracle(f", stop as (select id, max(workflow_status) as stop from ({_NONRUN}) group by 1) select t.id, case when stop = 'PAUSED' and status = 'CLAIMED' then 'PENDING' when stop = 'CANCELLED' and status in ('CLAIMED', 'PENDING') then 'CANCELLED' else status end as status, case when (stop = 'PAUSED' and status = 'CLAIMED') or (stop = 'CANCELLED' and status in ('CLAIMED', 'PENDING')) then null else claimed_by_worker_id end as claimed_by_worker_id from tasks t left join stop using (id)", "tasks", "workflow_tasks", "workflows"),
    "dag_edges": oracle(" select workflow_id, task_index, unnest(dependencies) as dep from workflow_tasks", "workflow_tasks"),
    "dep_status_counts": oracle(f"{_EDGES} select e.workflow_id, e.task_index, count(*) filter (n.status = 'COMPLETED') as completed, count(*) filter (n.status = 'FAILED') as failed, count(*) filter (n.status = 'SKIPPED') as skipped from (select distinct * from edges) e join workflow_tasks n on n.workflow_id = e.workflow_id and n.task_index = e.dep group by 1, 2", "workflow_tasks"),
    "join_readiness_round1": oracle(_VERDICT, "workflow_tasks", "workflows"),
    "dag_sinks": oracle(" select workflow_id, task_index, node_id, result from workflow_tasks w where not exists (select 1 from workflow_tasks o where o.workflow_id = w.workflow_id and list_contains(o.dependencies, w.task_index))", "workflow_tasks"),
    "dependents": oracle(f"{_EDGES} select distinct e.workflow_id, e.task_index from edges e join workflow_tasks p on p.workflow_id = e.workflow_id and p.task_index = e.task_index and p.status = 'PENDING' join workflow_tasks d on d.workflow_id = e.workflow_id and d.task_index = e.dep and d.status = 'COMPLETED'", "workflow_tasks"),
    "dependency_results": oracle(f"""{_EDGES}{_DAMAGED} select distinct e.workflow_id, e.task_index, e.dep, d.value as result from edges e join dn d on d.workflow_id = e.workflow_id and d.task_index = e.dep and d.status in {_ENDED} where d.value is not null""", "workflow_tasks"),
    "child_summary": oracle(f"{_PARENTS} select * from cs", "workflows", "workflow_tasks"),
    "completion_status": oracle(f" select w.id, w.status, w.completed_at, {_COUNTS} from workflows w left join workflow_tasks wt on wt.workflow_id = w.id group by 1, 2, 3", "workflows", "workflow_tasks"),
    "success_policy": oracle(f"{_SUCCESS} select * from succ", "workflows", "workflow_tasks"),
    "first_failed": oracle(" select workflow_id, task_index, result from workflow_tasks where status = 'FAILED' qualify row_number() over (partition by workflow_id order by task_index) = 1", "workflow_tasks"),
    "first_failed_required": oracle(" select n.workflow_id, n.task_index, n.result from workflow_tasks n join workflows w on w.id = n.workflow_id and w.success_policy is not null where n.status = 'FAILED' and n.task_index in (0, 1, 2) qualify row_number() over (partition by n.workflow_id order by n.task_index) = 1", "workflow_tasks", "workflows"),
    "final_results": oracle(f""", used as (select distinct workflow_id, unnest(dependencies) as task_index from workflow_tasks)
select w.id, coalesce(nullif(n.result, ''), 'null') as result from workflows w left join workflow_tasks n on n.workflow_id = w.id and n.task_index = w.output_task_index where w.output_task_index is not null
union all select w.id, {X.value("string_agg(concat(to_json(n.node_id), ':', coalesce(" + X.canonical("n.result") + ", 'null')), ',' order by n.node_id)")} from workflows w join workflow_tasks n on n.workflow_id = w.id
  where w.output_task_index is null and not exists (select 1 from used u where u.workflow_id = n.workflow_id and u.task_index = n.task_index) group by 1""", "workflows", "workflow_tasks"),
    "completions": oracle(f"{_SUCCESS}, c as (select w.id, {_COUNTS} from workflows w left join workflow_tasks wt on wt.workflow_id = w.id where w.status = 'RUNNING' and w.completed_at is null group by 1) select c.id, case when succeeded then 'COMPLETED' else 'FAILED' end as to from c join succ using (id) where incomplete = 0", "workflows", "workflow_tasks"),
    "on_error": oracle(f" select w.id, case when w.on_error = 'pause' then 'PAUSED' else 'RUNNING' end as to, {X.error_of('n.result')} as error from workflows w join (select workflow_id, result from workflow_tasks where status = 'FAILED' qualify row_number() over (partition by workflow_id order by task_index) = 1) n on n.workflow_id = w.id where w.status = 'RUNNING'", "workflows", "workflow_tasks"),
    "invalid_graphs": oracle(f""", f as (select * replace (case when {_WF_N} % 13 = 0 and task_index = 0 then [1] when {_WF_N} % 11 = 0 and task_index = 1 then [0, 99] else dependencies end as dependencies) from workflow_tasks),
e as (select distinct workflow_id, task_index, unnest(dependencies) as dep from f), known as (select workflow_id, task_index as dep from f),
asked as (select id as workflow_id, unnest(flatten(cast(json_extract(success_policy, '$.cases[*].required_indices') as int[][]))) as dep from workflows where success_policy is not null)
select distinct workflow_id, 'quorum over all dependencies' as problem from f where join_type = 'quorum' and min_success > len(dependencies)
union select workflow_id, 'no root' from f group by 1 having count(*) filter (len(dependencies) = 0) = 0
union select workflow_id, 'unknown dependency' from e anti join known using (workflow_id, dep)
union select a.workflow_id, 'cycle' from e a join e b on a.workflow_id = b.workflow_id and a.task_index = b.dep and a.dep = b.task_index
union select workflow_id, 'policy over unknown nodes' from asked anti join known using (workflow_id, dep)
union select id, 'unknown output' from (select id, id as workflow_id, output_task_index as dep from workflows where output_task_index is not null) anti join known using (workflow_id, dep)""", "workflow_tasks", "workflows"),
    "ctx_ready": oracle(f"{_EDGES} select e.workflow_id, e.task_index, count(*) filter (n.status in {_ENDED}) >= count(*) as ctx_ready from (select distinct * from edges) e left join workflow_tasks n on n.workflow_id = e.workflow_id and n.task_index = e.dep group by 1, 2", "workflow_tasks"),
    "node_context": oracle(f"""{_DAMAGED}, a as (select workflow_id, task_index, unnest(dependencies) as dep from workflow_tasks) select distinct a.workflow_id, a.task_index, n.node_id, n.value as result from a join dn n on n.workflow_id = a.workflow_id and n.task_index = a.dep and n.status in {_ENDED} where n.value is not null""", "workflow_tasks"),
    "results_with_names": oracle(f"{_DAMAGED} select workflow_id, task_index, node_id, concat(join_type, '#', task_index) as by_name, status, value as result from dn where status in {_ENDED} and value is not null and task_index <> 5", "workflow_tasks"),
    "node_arguments": oracle(f"""{_EDGES}{_DAMAGED}, v as (select distinct e.workflow_id, e.task_index, concat('"d', e.dep, '":{{"{Q.RESULT_TAG}":true,"data":', to_json(n.value), '}}') as part
  from edges e join dn n on n.workflow_id = e.workflow_id and n.task_index = e.dep and n.status in {_ENDED} where n.value is not null), p as (select workflow_id, task_index, string_agg(part, ',' order by part) as parts from v group by 1, 2),
k as (select w.workflow_id, w.task_index, is_subworkflow, cast(regexp_extract(workflow_id, '([0-9]+)$', 1) as bigint) as n, dependencies from workflow_tasks w),
c as (select *, case when n % 7 = 0 and list_contains(dependencies, 0) then 'WORKFLOW_ENQUEUE_FAILED' end as code from k)
select c.workflow_id, c.task_index, code, case when code is not null then concat('args_from key ''d0'' conflicts with static kwarg (', case when is_subworkflow then 'subworkflow ' else '' end, 'task ', c.task_index, ')') end as message,
  case when code is null then concat('{{', concat_ws(',', case when n % 7 = 0 then '"d0":1' when n % 2 = 0 then '"x":[1,"a"]' end, parts, concat('"{Q.META}":{{"workflow_id":"', c.workflow_id, '","task_index":', c.task_index, ',"task_name":null}}')), '}}') end as kwargs
from c left join p on p.workflow_id = c.workflow_id and p.task_index = c.task_index""", "workflow_tasks"),
    "tasks_of_nodes": oracle(f" select concat(workflow_id, '/', task_index) as id, 'PENDING' as status, {NOW} as enqueued_at, 0 as retry_count from workflow_tasks where status = 'ENQUEUED' and not is_subworkflow", "workflow_tasks"),
    "link_tasks": oracle(" select id, case when status = 'ENQUEUED' and not is_subworkflow then concat(workflow_id, '/', task_index) else task_id end as task_id from workflow_tasks", "workflow_tasks"),
    "children_of_nodes": oracle(f" select concat(n.workflow_id, '/', n.task_index) as id, w.name, 'RUNNING' as status, n.workflow_id as parent_workflow_id, n.task_index as parent_task_index, w.depth + 1 as depth, w.root_workflow_id, {NOW} as created_at from workflow_tasks n join workflows w on w.id = n.workflow_id where n.status = 'ENQUEUED' and n.is_subworkflow", "workflow_tasks", "workflows"),
    "parent_results": oracle(f"{_PARENTS} select workflow_id, task_index, \"to\", outcome, summary from pr", "workflows", "workflow_tasks"),
    "end_nodes": oracle(f"{_PARENTS}, o as (select workflow_id, task_index, min(struct_pack(k := \"to\", outcome := outcome, summary := summary)) as r from pr group by 1, 2), x as (select n.*, o.r, o.r is not null and n.status not in {_ENDED} as go from workflow_tasks n left join o on o.workflow_id = n.workflow_id and o.task_index = n.task_index) select id, case when go then r.k else status end as status, case when go then r.outcome else result end as result, case when go then r.summary end as sub_workflow_summary, go as changed from x", "workflows", "workflow_tasks"),
    "start_workflow": oracle(f" select id, case when len(dependencies) = 0 then 'READY' else 'PENDING' end as status, {NOW} as created_at from workflow_tasks", "workflow_tasks"),
    "rec_pending": oracle(f" select n.workflow_id, n.task_index, w.depth, w.root_workflow_id from workflow_tasks n join workflows w on w.id = n.workflow_id where n.status = 'PENDING' and w.status = 'RUNNING' and not exists (select 1 from workflow_tasks d where d.workflow_id = n.workflow_id and list_contains(n.dependencies, d.task_index) and d.status not in {_ENDED})", "workflow_tasks", "workflows"),
    "rec_ready": oracle(" select n.workflow_id, n.task_index, w.depth, w.root_workflow_id from workflow_tasks n join workflows w on w.id = n.workflow_id where n.status = 'READY' and n.task_index % 2 = 1 and not n.is_subworkflow and w.status = 'RUNNING'", "workflow_tasks", "workflows"),
    "rec_ready_sub": oracle(" select n.workflow_id, n.task_index, w.depth, w.root_workflow_id from workflow_tasks n join workflows w on w.id = n.workflow_id where n.status = 'READY' and n.is_subworkflow and w.status = 'RUNNING'", "workflow_tasks", "workflows"),
    "rec_children": oracle(f" select c.id, c.parent_workflow_id, c.parent_task_index, c.status from workflows c join workflows p on p.id = c.parent_workflow_id join workflow_tasks n on n.workflow_id = p.id and n.task_index = c.parent_task_index where c.status in {_WF_ENDED} and n.status = 'RUNNING' and p.status = 'RUNNING'", "workflows", "workflow_tasks"),
    "rec_crashed": oracle(f" select n.workflow_id, n.task_index, n.task_id, upper(t.status) as task_status from workflow_tasks n join tasks t on t.id = n.task_id join workflows w on w.id = n.workflow_id where n.status not in {_ENDED} and not n.is_subworkflow and w.status = 'RUNNING' and upper(t.status) in {_TASK_ENDED}", "workflow_tasks", "tasks", "workflows"),
    "rec_terminal": oracle(f" select w.id, count(*) filter (wt.status = 'FAILED') as failed_count from workflows w left join workflow_tasks wt on wt.workflow_id = w.id where w.status = 'RUNNING' and not exists (select 1 from workflow_tasks x where x.workflow_id = w.id and x.status not in {_ENDED}) group by 1", "workflows", "workflow_tasks"),
    "expire_pending": oracle(f" select id, case when late then 'EXPIRED' else status end as status, case when late then 'TASK_EXPIRED' else error_code end as error_code, case when late then {LATE} end as result from (select *, coalesce(status = 'PENDING' and good_until <= {NOW}, false) as late from tasks)", "tasks"),
    "requeue_claimed": oracle(f" select id, case when s then 'PENDING' else status end as status, case when s then null else claimed_by_worker_id end as claimed_by_worker_id from (select t.*, coalesce(status = 'CLAIMED' and coalesce(last_heartbeat, enqueued_at) < {NOW} - interval 120 second, false) as s from tasks t left join {_HB.format('claimer')} hb on hb.task_id = t.id)", "tasks", "heartbeats"),
    "mark_stale_failed": oracle(f" select id, case when s then 'FAILED' else status end as status, case when s then 'WORKER_CRASHED' else error_code end as error_code, case when s then {NOW} else failed_at end as failed_at, case when s then '{REASON}' end as failed_reason, case when s then {CRASHED} end as result from (select t.*, coalesce({_STALE}, false) as s from tasks t left join {_HB.format('runner')} hb on hb.task_id = t.id)", "tasks", "heartbeats"),
    "renew_lease": oracle(f" select id, status, case when status = 'CLAIMED' and claimed_by_worker_id = 'worker-7' and enqueued_at >= {NOW} - interval 7 day then {NOW} + interval 60 second else claim_expires_at end as claim_expires_at from tasks", "tasks"),
    "start_claimed": oracle(f", stop as (select distinct id from ({_NONRUN})), x as (select t.*, coalesce(status = 'CLAIMED' and claimed_by_worker_id = 'worker-1' and (claim_expires_at is null or claim_expires_at > {NOW}) and (good_until is null or good_until > {NOW}) and s.id is null, false) as go from tasks t left join stop s on s.id = t.id) select id, case when go then 'RUNNING' else status end as status, case when go then {NOW} else started_at end as started_at from x", "tasks", "workflow_tasks", "workflows"),
    "finalize_outcomes": oracle(f"""{_OUT}, x as (select t.*, o.kind, o.task_id is not null and status = 'RUNNING' as own from tasks t left join o on o.task_id = t.id)
select id, case when own then case when kind = 0 then 'COMPLETED' else 'FAILED' end else status end as status, case when own and kind <> 6 then '{{"ok":1}}' end as result,
case when own then case when kind = 3 then 'TASK_EXCEPTION' end else error_code end as error_code, case when own and kind = 6 then 'worker lost' end as failed_reason from x""", "tasks"),
    "attempts_of": oracle(f"{_OUT} select task_id, retry_count + 1 as attempt, case when kind = 0 then 'COMPLETED' when kind = 6 then 'WORKER_FAILURE' else 'FAILED' end as outcome, false as will_retry, started_at, {NOW} as finished_at, case when kind = 3 then 'TASK_EXCEPTION' end as error_code, claimed_by_worker_id as worker_id from tasks t join o on o.task_id = t.id where status = 'RUNNING'", "tasks"),
    "upsert_attempts": oracle(" select task_id, attempt, case when attempt = 2 then 'FAILED' else outcome end as outcome, will_retry, started_at, finished_at, case when attempt = 2 then 'TASK_EXCEPTION' else error_code end as error_code, worker_id from task_attempts union all select task_id, 9, 'FAILED', will_retry, started_at, finished_at, 'TASK_EXCEPTION', worker_id from task_attempts where attempt = 2", "task_attempts"),
    "enqueue_conflicts": oracle(f" select case when {_N} % 3 = 0 then concat(id, '-new') else id end as id, case {_N} % 3 when 0 then 'new' when 1 then 'same' else 'mismatch' end as verdict from tasks", "tasks"),
    "retry_plan": oracle(f""", k as (select *, cast(regexp_extract(task_name, '([0-9]+)$', 1) as int) % 3 as kind from tasks where status = 'RUNNING'),
d as (select *, cast(case kind when 0 then case when retry_count >= 1 then 20 else 10 end when 1 then 30 * pow(2, retry_count) end as bigint) as delay from k),
v as (select *, case when kind = 2 or retry_count >= max_retries or not coalesce(good_until > {NOW}, true) then 'none' when good_until is not null and {NOW} + to_seconds(delay) >= good_until then 'expired' else 'scheduled' end as verdict from d)
select id, verdict, case when verdict = 'scheduled' then delay end as delay_seconds, case when verdict = 'scheduled' then {NOW} + to_seconds(delay) end as retry_at from v""", "tasks"),
    "cancel_workflow": oracle(f""", x as (select n.*, w.status in ('RUNNING', 'PAUSED') as hit, t.status as task from workflow_tasks n left join workflows w on w.id = n.workflow_id left join tasks t on t.id = n.task_id),
drop_ as (select distinct task_id from x where hit and status = 'ENQUEUED' and task in ('PENDING', 'CLAIMED'))
select 'workflow' as kind, id, case when status in ('RUNNING', 'PAUSED') then 'CANCELLED' else status end as status from workflows
union all select 'node', id, case when hit and status = 'ENQUEUED' and task = 'RUNNING' then 'RUNNING' when hit and status = 'ENQUEUED' and task in ('PENDING', 'CLAIMED', 'CANCELLED') then 'SKIPPED' when hit and status in ('PENDING', 'READY') then 'SKIPPED' else status end from x
union all select 'task', id, case when id in (select task_id from drop_) then 'CANCELLED' else status end from tasks""", "workflows", "workflow_tasks", "tasks"),
    "pause_cascade": oracle(""", w as (select * replace (case when status = 'COMPLETED' then 'RUNNING' else status end as status) from workflows),
hit as (select id from w where parent_workflow_id is null and status = 'RUNNING' union select c.id from w c join w p on p.id = c.parent_workflow_id and p.parent_workflow_id is null and p.status = 'RUNNING' where c.status = 'RUNNING')
select id, case when id in (select id from hit) then 'PAUSED' else status end as status, id in (select id from hit) as changed from w""", "workflows"),
    "resume": oracle(" select id, case when status = 'PAUSED' then 'RUNNING' else status end as status, status = 'PAUSED' as changed from workflows", "workflows"),
    "enqueue_nodes": oracle(", x as (select n.*, coalesce(w.status = 'RUNNING' and n.status = 'READY' and not n.is_subworkflow, false) as go from workflow_tasks n left join workflows w on w.id = n.workflow_id) select id, case when go then 'ENQUEUED' else status end as status, go as changed from x", "workflow_tasks", "workflows"),
    "claimer_heartbeats": oracle(f" select id as task_id, 'worker-7' as sender_id, 'claimer' as role, {NOW} as sent_at, 'host-1' as hostname, 42 as pid from tasks where status = 'CLAIMED' and claimed_by_worker_id = 'worker-7'", "tasks"),
    "change_feed": oracle(f" select 'done' as channel, id as payload, 'PENDING' as was, 'EXPIRED' as status from tasks where status = 'PENDING' and good_until <= {NOW}", "tasks"),
    "retention_heartbeats": oracle(f" select * from heartbeats where not sent_at < {NOW} - interval 600 second", "heartbeats"),
    "retention_worker_states": oracle(f" select id, worker_id, snapshot_at from worker_states where not snapshot_at < {NOW} - interval 7 day", "worker_states"),
    "retention_workflows": oracle(f", kept as (select * from workflows where not (status in {_WF_ENDED} and coalesce(completed_at, updated_at, created_at) < {NOW} - interval 30 day)) select id, status from kept k where parent_workflow_id is null or exists (select 1 from kept p where p.id = k.parent_workflow_id)", "workflows"),
    "retention_workflow_tasks": oracle(f" select n.id, n.workflow_id from workflow_tasks n where not exists (select 1 from workflows w where w.id = n.workflow_id and w.status in {_WF_ENDED} and coalesce(w.completed_at, w.updated_at, w.created_at) < {NOW} - interval 30 day)", "workflow_tasks", "workflows"),
    "retention_tasks": oracle(f" select id, status from tasks t where not (status in {_TASK_ENDED} and coalesce(completed_at, failed_at, enqueued_at) < {NOW} - interval 1 day and not exists (select 1 from workflow_tasks n join workflows w on w.id = n.workflow_id where n.task_id = t.id and w.status not in {_WF_ENDED}))", "tasks", "workflow_tasks", "workflows"),
    "due_schedules": oracle(f" select * from schedule_state where next_run_at is null or next_run_at <= {NOW}", "schedule_state"),
    "next_run_interval": oracle(" select schedule_name, last_run_at + interval 5400 second as next_run from schedule_state", "schedule_state"),
    "next_run_hourly": _next_sql("Asia/Kolkata", "select *, date_trunc('hour', l) + to_hours(i) + interval 930 second as c from s, range(6) r(i)"),
    "next_run_daily": _next_sql("America/New_York", "select *, date_trunc('day', l) + to_days(cast(i as int)) + interval 9000 second as c from s, range(8) r(i)"),
    "next_run_weekly": _next_sql("Europe/Berlin", "select *, date_trunc('day', l) + to_days(cast(i as int)) + interval 35100 second as c from s, range(15) r(i) where isodow(date_trunc('day', l) + to_days(cast(i as int))) in (2, 5)"),
    "next_run_monthly": _next_sql("UTC", "select *, date_trunc('month', l) + to_months(cast(i as int)) + interval 30 day + interval 6 hour as c from s, range(25) r(i) where day(last_day(date_trunc('month', l) + to_months(cast(i as int)))) >= 31"),
    "missed_runs": oracle(f""", f as (select schedule_name, coalesce(next_run_at, last_run_at) as first from schedule_state),
slots as (select schedule_name, first as slot from f where first <= {NOW} union all select schedule_name, date_trunc('day', first) + to_days(cast(i as int)) + interval 3 hour from f, range(40) r(i) where date_trunc('day', first) + to_days(cast(i as int)) + interval 3 hour > first and date_trunc('day', first) + to_days(cast(i as int)) + interval 3 hour <= {NOW})
select schedule_name, slot from slots qualify row_number() over (partition by schedule_name order by slot) <= 10""", "schedule_state"),
    "schedule_slot_id": oracle(f" select schedule_name, {_UUID} as slot_id from (select schedule_name, sha1(unhex('{ids.NAMESPACE}') || encode(concat(schedule_name, ':', {_ISO.format('last_run_at')}))) as h from schedule_state)", "schedule_state"),
    "enqueue_fingerprint": oracle(f""" select id, sha256(concat('["', task_name, '","', queue_name, '",', priority, ',null,null,"', {_ISO.format('enqueued_at')}, '",', case when good_until is null then 'null' else concat('"', {_ISO.format('good_until')}, '"') end, ',null,null]')) as enqueue_sha from tasks""", "tasks"),
}
#: Transitions write columns that the fixtures lack.
for _name in "claim_tasks guard_workflows end_nodes expire_pending requeue_claimed mark_stale_failed renew_lease start_claimed finalize_outcomes cancel_workflow pause_cascade resume enqueue_nodes change_feed".split():
    QUERIES[_name] = lambda t, query=QUERIES[_name]: query(full(t))
