"""Monitoring queries by name, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuelens.operators import monitor as M
from queuelens.sources.fixtures import oracle
from queuelens.sources.tables import Tables

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_STATES = ("pending", "claimed", "running", "completed", "failed", "cancelled", "expired")
_COUNTS = ", ".join(f"count(*) filter (status = '{s.upper()}') as {s}_count" for s in _STATES)


def _breakdown(where: str) -> str:
    return oracle(
        f""", agg as (
  select claimed_by_worker_id, grouping(claimed_by_worker_id) as g, count(*) as total_count, {_COUNTS}, count(*) filter (retry_count > 0) as retried_count,
    array_agg(id order by enqueued_at, id) as ids, array_agg(retry_count order by enqueued_at, id) as counts
  from tasks where {where} group by rollup (claimed_by_worker_id)
)
select case when g = 1 then 'TOTAL' else coalesce(claimed_by_worker_id, 'unknown') end as worker_id, total_count, {", ".join(f"{s}_count" for s in _STATES)}, retried_count,
  case when g = 1 then null else ids end as claimed_task_ids, null::varchar[] as running_task_ids, case when g = 1 then null else counts end as claimed_retry_counts, null::int[] as running_retry_counts
from agg""",
        "tasks",
    )


def _facets(where: str) -> str:
    part = lambda kind, col, k, more="": f"select * from (select '{kind}' as kind, {col} as value, count(*) as count from tasks where {where}{more} group by {col} order by count(*) desc, {col} limit {k})"
    return oracle(" " + " union all ".join([part("task_name", "task_name", 30), part("queue", "queue_name", 30), part("error", "error_code", 20, " and error_code is not null")]), "tasks")


_TASK_COLUMNS = "id, task_name, queue_name, status, error_code, retry_count, max_retries, enqueued_at, started_at, completed_at, failed_at"
_LATEST = "row_number() over (partition by worker_id order by snapshot_at desc, id desc)"
_NODE_COUNTS = (
    "count(wt.id) as total_tasks, count(*) filter (wt.status = 'COMPLETED') as completed_tasks, count(*) filter (wt.status = 'FAILED') as failed_tasks, "
    "count(*) filter (wt.status = 'RUNNING') as running_tasks, count(*) filter (wt.status in ('PENDING', 'READY')) as pending_tasks, "
    "count(*) filter (wt.status = 'ENQUEUED') as enqueued_tasks, count(*) filter (wt.status = 'SKIPPED') as skipped_tasks"
)
_ACTIVE = f"select * from worker_states where snapshot_at > {NOW} - interval 2 minute qualify {_LATEST} = 1"
_OVERLOADED = f"select * from worker_states where snapshot_at > {NOW} - interval 5 minute and (memory_percent > 85 or cpu_percent > 80) qualify {_LATEST} = 1"
_LAST = f"select * from worker_states qualify {_LATEST} = 1"
_CLAIMING = f"select * from worker_states where snapshot_at > {NOW} - interval 2 minute and tasks_claimed > tasks_running * 2 qualify {_LATEST} = 1"


def _rounded(x: str, places: int) -> str:
    return f"cast(round(cast({x} as decimal(38,10)), {places}) as double)"


def _workflows(where: str, tail: str) -> str:
    return oracle(f" select w.*, {_NODE_COUNTS} from workflows w left join workflow_tasks wt on wt.workflow_id = w.id where {where} group by all {tail}", "workflows", "workflow_tasks")


QUERIES = {
    "task_breakdown": lambda t: M.task_breakdown(t.tasks),
    "task_breakdown_first": lambda t: M.task_breakdown(t.tasks, most=5).select("worker_id", "total_count", "retried_count", F.array_join("claimed_task_ids", ",").alias("ids")),
    "task_ids": lambda t: M.task_ids(t.tasks, True, ["FAILED", "RUNNING"]),
    "task_breakdown_filtered": lambda t: M.task_breakdown(t.tasks, True, ["FAILED", "RUNNING"]),
    "task_facets": lambda t: M.task_facets(t.tasks, statuses=("FAILED", "COMPLETED")),
    "queue_facets": lambda t: M.facet(M.task_facets(t.tasks, statuses=("FAILED", "COMPLETED")), "queue"),
    "task_status_view": lambda t: M.task_status_view(t.tasks),
    "task_list": lambda t: M.task_list(t.tasks, statuses=("RUNNING", "FAILED"), retried_only=True),
    "task_detail": lambda t: M.task_detail(t.tasks, "task-102"),
    "task_attempts": lambda t: M.task_attempts(t.task_attempts, "task-102"),
    "task_info": lambda t: M.task_info(t.tasks, t.task_attempts, "task-102").select("id", "status", "attempts.attempt", "attempts.outcome"),
    "active_workers": lambda t: M.active_workers(t.worker_states, t.as_of),
    "cluster_capacity": lambda t: M.cluster_capacity(t.worker_states, t.as_of),
    "utilization_trend": lambda t: M.utilization_trend(t.worker_states, t.as_of),
    "dead_workers": lambda t: M.dead_workers(t.worker_states, t.as_of),
    "overloaded_workers": lambda t: M.overloaded_workers(t.worker_states, t.as_of),
    "snapshot_age": lambda t: M.snapshot_age(t.worker_states, t.as_of),
    "stale_claims": lambda t: M.stale_claims(t.worker_states, t.as_of),
    "worker_queues": lambda t: M.worker_queues(t.worker_states, t.as_of),
    "worker_uptime": lambda t: M.worker_uptime(t.worker_states, t.as_of),
    "worker_load": lambda t: M.worker_load(t.worker_states, t.as_of),
    "worker_load_one": lambda t: M.worker_load(t.worker_states, t.as_of, "24h", "worker-7"),
    "load_scale": lambda t: M.load_scale(t.worker_states, t.as_of, "24h"),
    "workflow_list": lambda t: M.workflow_list(t.workflows, t.workflow_tasks),
    "workflow_list_filtered": lambda t: M.workflow_list(t.workflows, t.workflow_tasks, ["RUNNING", "PAUSED"]),
    "workflow_detail": lambda t: M.workflow_detail(t.workflow_tasks, "wf-5"),
    "workflow_summary": lambda t: M.workflow_summary(t.workflows),
    "workflow_by_id": lambda t: M.workflow_by_id(t.workflows, t.workflow_tasks, "wf-5"),
    "workflow_progress": lambda t: M.workflow_progress(t.workflows, t.workflow_tasks, t.as_of),
    "search_workers": lambda t: M.search_workers(t.worker_states, t.as_of, "IDLE"),
    "search_tasks": lambda t: M.search_tasks(t.tasks, "Worker-12"),
    "search_workflows": lambda t: M.search_workflows(t.workflows, "paus"),
    "search_alerts": lambda t: M.search_alerts(t.worker_states, t.as_of, "host-3"),
}

_SECONDS = f"date_diff('second', created_at, coalesce(completed_at, {NOW}))"
ORACLES = {
    "task_breakdown": _breakdown("true"),
    "task_breakdown_first": oracle(", r as (select *, coalesce(claimed_by_worker_id, 'unknown') as worker_id, row_number() over (partition by claimed_by_worker_id order by enqueued_at, id) as place from tasks) select worker_id, count(*) as total_count, count(*) filter (retry_count > 0) as retried_count, string_agg(id, ',' order by enqueued_at, id) filter (place <= 5) as ids from r group by 1 union all select 'TOTAL', count(*), count(*) filter (retry_count > 0), null from tasks", "tasks"),
    "task_ids": oracle(" select coalesce(claimed_by_worker_id, 'unknown') as worker_id, id, retry_count, enqueued_at from tasks where retry_count > 0 and status in ('FAILED', 'RUNNING')", "tasks"),
    "task_breakdown_filtered": _breakdown("retry_count > 0 and status in ('FAILED', 'RUNNING')"),
    "queue_facets": oracle(" select queue_name as value, count(*) as count from tasks where status in ('FAILED', 'COMPLETED') group by 1 qualify row_number() over (order by count(*) desc, queue_name) <= 30", "tasks"),
    "task_facets": _facets("status in ('FAILED', 'COMPLETED')"),
    "task_status_view": oracle(
        """ select s.status, coalesce(c.n, 0) as count, s.sort_order
from (values ('pending', 1), ('claimed', 2), ('running', 3), ('completed', 4), ('failed', 5), ('cancelled', 6), ('requeued', 7)) s(status, sort_order)
left join (select lower(status) as status, count(*) as n from tasks group by 1) c on c.status = s.status
union all select 'TOTAL', count(*), 8 from tasks""",
        "tasks",
    ),
    "task_list": oracle(f" select {_TASK_COLUMNS} from tasks where status in ('RUNNING', 'FAILED') and retry_count > 0 order by enqueued_at desc, id limit 500", "tasks"),
    "task_detail": oracle(" select * from tasks where id = 'task-102'", "tasks"),
    "task_attempts": oracle(" select * from task_attempts where task_id = 'task-102'", "task_attempts"),
    "task_info": oracle(
        """ select t.id, t.status, a.attempt, a.outcome from tasks t left join
(select task_id, array_agg(attempt order by attempt desc) as attempt, array_agg(outcome order by attempt desc) as outcome from task_attempts group by task_id) a on a.task_id = t.id where t.id = 'task-102'""",
        "tasks", "task_attempts",
    ),
    "active_workers": oracle(f" select worker_id, hostname, pid, processes, tasks_running, tasks_claimed, memory_percent, cpu_percent, snapshot_at from ({_ACTIVE})", "worker_states"),
    "cluster_capacity": oracle(
        f""" select count(distinct worker_id) as active_workers, cast(sum(processes) as bigint) as total_capacity, cast(sum(tasks_running) as bigint) as total_running, cast(sum(tasks_claimed) as bigint) as total_claimed,
{_rounded("100.0::double * sum(tasks_running) / nullif(sum(processes)::double, 0)", 2)} as cluster_utilization_pct, {_rounded("avg(memory_percent)", 1)} as avg_memory_pct, {_rounded("avg(cpu_percent)", 1)} as avg_cpu_pct
from ({_ACTIVE})""",
        "worker_states",
    ),
    "utilization_trend": oracle(
        f""" select date_trunc('minute', snapshot_at) as minute, {_rounded("avg(tasks_running::double / nullif(processes::double, 0)) * 100", 2)} as avg_utilization_pct,
cast(sum(tasks_running) as bigint) as total_running, cast(sum(processes) as bigint) as total_capacity
from worker_states where snapshot_at > {NOW} - interval 1 hour group by 1""",
        "worker_states",
    ),
    "dead_workers": oracle(f" select worker_id, hostname, pid, snapshot_at as last_seen, date_diff('second', snapshot_at, {NOW}) as offline_seconds, tasks_claimed as tasks_at_death from ({_LAST}) where snapshot_at < {NOW} - interval 2 minute", "worker_states"),
    "overloaded_workers": oracle(f" select worker_id, hostname, memory_percent, cpu_percent, tasks_running, processes, snapshot_at from ({_OVERLOADED})", "worker_states"),
    "snapshot_age": oracle(
        f""" select case when snapshot_at > {NOW} - interval 1 hour then '< 1 hour' when snapshot_at > {NOW} - interval 24 hour then '1-24 hours'
when snapshot_at > {NOW} - interval 7 day then '1-7 days' when snapshot_at > {NOW} - interval 30 day then '7-30 days' else '> 30 days' end as age_bucket,
count(*) as snapshot_count, count(distinct worker_id) as unique_workers from worker_states group by 1""",
        "worker_states",
    ),
    "stale_claims": oracle(f" select worker_id, hostname, tasks_running, tasks_claimed, {_rounded('tasks_claimed::double / nullif(tasks_running::double, 0)', 2)} as claim_ratio, snapshot_at from ({_CLAIMING})", "worker_states"),
    "worker_queues": oracle(f" select worker_id, hostname, queue_priorities, tasks_running, tasks_claimed from ({_ACTIVE})", "worker_states"),
    "worker_uptime": oracle(f" select worker_id, hostname, worker_started_at, snapshot_at as last_seen, date_diff('second', worker_started_at, snapshot_at) as uptime_seconds from (select * from worker_states where snapshot_at > {NOW} - interval 5 minute qualify {_LATEST} = 1)", "worker_states"),
    "worker_load_one": oracle(f" select worker_id, snapshot_at, tasks_running, tasks_claimed, memory_percent, cpu_percent from worker_states where snapshot_at > {NOW} - interval 24 hour and worker_id = 'worker-7'", "worker_states"),
    "worker_load": oracle(f" select worker_id, snapshot_at, tasks_running, tasks_claimed, memory_percent, cpu_percent from worker_states where snapshot_at > {NOW} - interval 1 hour", "worker_states"),
    "load_scale": oracle(f" select worker_id, max(tasks_running) as max_running, max(tasks_claimed) as max_claimed from worker_states where snapshot_at > {NOW} - interval 24 hour group by 1", "worker_states"),
    "workflow_list": _workflows("true", "order by created_at desc, w.id limit 100"),
    "workflow_list_filtered": _workflows("w.status in ('RUNNING', 'PAUSED')", "order by created_at desc, w.id limit 100"),
    "workflow_detail": oracle(" select * from workflow_tasks where workflow_id = 'wf-5'", "workflow_tasks"),
    "workflow_summary": oracle(" select " + ", ".join(f"count(*) filter (status = '{s.upper()}') as {s}" for s in ("pending", "running", "completed", "failed", "paused", "cancelled")) + " from workflows", "workflows"),
    "workflow_by_id": _workflows("w.id = 'wf-5'", ""),
    "workflow_progress": oracle(
        f""", c as (select w.*, {_NODE_COUNTS} from workflows w left join workflow_tasks wt on wt.workflow_id = w.id group by all),
d as (select *, completed_tasks + failed_tasks + skipped_tasks as terminal_tasks, {_SECONDS} as s from c)
select id, name, status, total_tasks, terminal_tasks, case when total_tasks > 0 then terminal_tasks::double / total_tasks::double else 0.0::double end as progress,
  case when terminal_tasks > 0 then completed_tasks::double / terminal_tasks::double else 0.0::double end as success_rate,
  case when s is null then '-' when s < 60 then concat(s, 's') when s < 3600 then concat(s // 60, 'm ', s % 60, 's') else concat(s // 3600, 'h ', (s % 3600) // 60, 'm') end as duration
from d""",
        "workflows", "workflow_tasks",
    ),
    "search_workers": oracle(f" select worker_id, hostname, case when tasks_running > 0 then 'Running' else 'Idle' end as state from ({_ACTIVE}) where contains(lower(concat(worker_id, chr(10), hostname, chr(10), case when tasks_running > 0 then 'running' else 'idle' end)), 'idle')", "worker_states"),
    "search_tasks": oracle(" select coalesce(claimed_by_worker_id, 'unknown') as worker_id, id from tasks where contains(lower(id), 'worker-12') or contains(lower(coalesce(claimed_by_worker_id, 'unknown')), 'worker-12')", "tasks"),
    "search_workflows": oracle(" select id, name, status from workflows where contains(lower(id), 'paus') or contains(lower(name), 'paus') or contains(lower(status), 'paus')", "workflows"),
    "search_alerts": oracle(
        f""" select * from (select 'overloaded' as alert, worker_id, hostname from ({_OVERLOADED}) union all select 'dead', worker_id, hostname from ({_LAST}) where snapshot_at < {NOW} - interval 2 minute
union all select 'stale claims', worker_id, hostname from ({_CLAIMING})) where contains(alert, 'host-3') or contains(worker_id, 'host-3') or contains(hostname, 'host-3')""",
        "worker_states",
    ),
}
__all__ = ["NOW", "ORACLES", "QUERIES", "Tables"]
