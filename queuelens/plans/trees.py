"""Queries on trees of workflows, by name, with oracles that go through the levels one by one.

The oracles follow the rules of completion for four nodes: two without
dependencies, one that depends on both, and one that depends on that.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from queuelens.operators import engine as E
from queuelens.plans import resultsql as X
from queuelens.plans.state import _ENDED, NOW
from queuelens.sources import fixtures
from queuelens.sources.fixtures import oracle
from queuelens.sources.tables import Tables, completed

_LEVELS = (3, 2, 1, 0)


def _with_trees(t: Tables) -> Tables:
    """Trees of six workflows and four levels in place of the workflows; some nodes can't be built."""
    n = F.regexp_extract("workflow_id", r"(\d+)$", 1).cast("long")
    spark, path = t.workflows.sparkSession, t.path
    nodes = fixtures.table(spark, path, "tree_nodes").withColumn("args_from", F.when((F.col("task_index") == 2) & (n % 2 == 1), F.create_map(F.lit("d0"), F.lit(0))))
    return completed(replace(t, workflows=fixtures.table(spark, path, "tree_workflows"), workflow_tasks=nodes))


def _outcomes(t: Tables):
    return fixtures.table(t.workflows.sparkSession, t.path, "tree_outcomes")


def _rows(flows, nodes):
    rows = flows.select(F.lit("workflow").alias("kind"), "id", "status", "result", "error", F.lit(None).cast("string").alias("summary"))
    return rows.unionByName(nodes.select(F.lit("node").alias("kind"), "id", "status", "result", F.lit(None).cast("string").alias("error"), F.col("sub_workflow_summary").alias("summary")))


def _complete_tree(t: Tables):
    t2 = _with_trees(t)
    flows, nodes, _ = E.complete_tree(t2.workflows, t2.workflow_tasks, _outcomes(t), t.as_of)
    return _rows(flows, nodes)


def _tree_tasks(t: Tables):
    t2 = _with_trees(t)
    return E.complete_tree(t2.workflows, t2.workflow_tasks, _outcomes(t), t.as_of)[2].select("id", "task_name", "kwargs", "max_retries", "status", "sent_at")


QUERIES = {"complete_tree": _complete_tree, "tree_tasks": _tree_tasks}


def _level(d: int) -> str:
    """CTEs of one level: s{d} nodes at the end, g{d} workflows at the end, p{d} what they are to their parents' nodes."""
    events = "select workflow_id, task_index, case when ok then 'COMPLETED' else 'FAILED' end as k, o.result as outcome, null::varchar as summary from tree_outcomes o join tree_nodes using (task_id)"
    if d < 3:
        events += f" union all select * from p{d + 1}"
    counts = "(f.c0 = 'COMPLETED')::int + (f.c1 = 'COMPLETED')::int"
    over = f"(f.c0 in {_ENDED})::int + (f.c1 in {_ENDED})::int"
    fault2 = X.failed(X.error("case when n % 11 = 4 then 'WORKER_SERIALIZATION_ERROR' else 'WORKFLOW_ENQUEUE_FAILED' end", "case when n % 11 = 4 then 'Corrupt kwargs JSON for task 2' else 'args_from key ''d0'' conflicts with static kwarg (task 2)' end", "concat('{\"workflow_id\":\"', id, '\",\"task_index\":2}')"))
    fault3 = X.failed(X.error("'WORKER_SERIALIZATION_ERROR'", "'Invalid task_options payload for task 3: expected object'", "concat('{\"workflow_id\":\"', id, '\",\"task_index\":3}')"))
    sinks = X.value("concat('\"n3\":', coalesce(" + X.canonical("r3") + ", 'null'))")
    first = f"case when c0 = 'FAILED' then {X.error_of('r0')} when c1 = 'FAILED' then {X.error_of('r1')} when c2 = 'FAILED' then {X.error_of('r2')} when c3 = 'FAILED' then {X.error_of('r3')} end"
    required = f"case when c0 = 'FAILED' then {X.error_of('r0')} when c1 = 'FAILED' then {X.error_of('r1')} when c2 = 'FAILED' then {X.error_of('r2')} end"
    output = f"coalesce({X.member(X.canonical('result'), '$.ok')}, 'null')"
    said = f"case when error is not null then coalesce({X.member('error', '$.message')}, 'null') else 'null' end"
    tally = lambda s: " + ".join(f"(c{i} = '{s}')::int" for i in range(4))
    summary = f"""concat('{{"status":"', status, '","output":', {output}, ',"total_tasks":4,"completed_tasks":', {tally("COMPLETED")}, ',"failed_tasks":', {tally("FAILED")}, ',"skipped_tasks":', {tally("SKIPPED")}, ',"error_summary":', {said}, '}}')"""
    child = """concat('{"__task_result__":true,"ok":null,"err":{"__task_error__":true,"error_code":{"__builtin_task_code__":"SUBWORKFLOW_FAILED"},"data":null,"message":"Subworkflow ', id, ' failed with status ', status, '","sub_workflow_id":"', id, '","sub_workflow_summary":', summary, '}}')"""
    old = "case when status = 'RUNNING' and {bad} and on_error = 'pause' then 'PAUSED' else status end as status, case when status = 'RUNNING' and {bad} then {error} else error end as error"
    join3 = "case when {c} = 'PENDING' and hot and status = 'RUNNING' and {two} in ('SKIPPED', 'FAILED') then case when kind = 'all' and allow then 'READY' else 'SKIPPED' end else {c} end"
    return f""", v{d} as ({events}),
e{d} as (select x.*, case when v.k is not null and x.status not in {_ENDED} then v.k else x.status end as st, case when v.k is not null and x.status not in {_ENDED} then v.outcome else x.result end as res, case when v.k is not null and x.status not in {_ENDED} then v.summary end as summ,
  v.k is not null as told, v.k = 'FAILED' and x.status not in {_ENDED} as fresh from tree_nodes x join tree_workflows w on w.id = x.workflow_id and w.depth = {d} left join v{d} v on v.workflow_id = x.workflow_id and v.task_index = x.task_index),
f{d} as (select w.*, cast(substr(w.id, 4) as bigint) as n, max(st) filter (task_index = 0) as c0, max(st) filter (task_index = 1) as c1, max(st) filter (task_index = 2) as c2, max(st) filter (task_index = 3) as c3,
  max(res) filter (task_index = 0) as r0, max(res) filter (task_index = 1) as r1, max(join_type) as kind, max(min_success) filter (task_index = 2) as need, bool_or(allow_failed_deps) as allow, bool_or(told) as hot, bool_or(coalesce(fresh, false)) as fresh, min_by(res, task_index) filter (fresh) as fresh_result
  from tree_workflows w join e{d} e on e.workflow_id = w.id group by all),
a{d} as (select f.* replace ({old.format(bad="fresh", error=X.error_of("fresh_result"))}), {counts} as c, {over} as t, n % 11 = 4 or n % 11 = 5 and n % 2 = 1 as bad2, n % 11 = 6 as bad3 from f{d} f),
b{d} as (select *, case when c2 <> 'PENDING' or not hot or status <> 'RUNNING' then c2 when kind = 'any' and t = 2 and c = 0 then 'SKIPPED' when kind = 'quorum' and c + 2 - t < need then 'SKIPPED'
  when kind = 'all' and t = 2 then case when c < 2 and not allow then 'SKIPPED' else 'READY' end when kind = 'any' and c >= 1 then 'READY' when kind = 'quorum' and c >= need then 'READY' else 'PENDING' end as w2 from a{d}),
h{d} as (select *, {join3.format(c="c3", two="w2")} as w3 from b{d}),
i{d} as (select * exclude (c2, c3), case when w2 = 'READY' then case when bad2 then 'FAILED' else 'ENQUEUED' end else w2 end as c2, case when w2 = 'READY' and bad2 then {fault2} end as r2,
  case when w3 = 'READY' then case when bad3 then 'FAILED' else 'ENQUEUED' end else w3 end as c3, case when w3 = 'READY' and bad3 then {fault3} end as r3 from h{d}),
j{d} as (select * replace ({old.format(bad="(w2 = 'READY' and bad2 or w3 = 'READY' and bad3)", error=X.error_of("coalesce(r2, r3)"))}) from i{d}),
k{d} as (select *, {join3.format(c="c3", two="c2")} as w4 from j{d}),
l{d} as (select * exclude (c3) replace (case when w4 = 'READY' and bad3 then {fault3} else r3 end as r3), case when w4 = 'READY' then case when bad3 then 'FAILED' else 'ENQUEUED' end else w4 end as c3 from k{d}),
m{d} as (select * replace ({old.format(bad="w4 = 'READY' and bad3", error=X.error_of("r3"))}) from l{d}),
o{d} as (select *, hot and status = 'RUNNING' and c0 in {_ENDED} and c1 in {_ENDED} and c2 in {_ENDED} and c3 in {_ENDED} as go, case when success_policy is null then error is null and not (c0 = 'FAILED' or c1 = 'FAILED' or c2 = 'FAILED' or c3 = 'FAILED') else c1 = 'COMPLETED' or c0 = 'COMPLETED' and c2 = 'COMPLETED' end as fine from m{d}),
g{d} as (select * replace (case when go then case when fine then 'COMPLETED' else 'FAILED' end else status end as status, case when go then case when output_task_index = 3 then coalesce(r3, 'null') else {sinks} end end as result,
  case when go and not fine then coalesce(case when success_policy is null then {first} else coalesce({required}, {X.CASE_NOT_MET}) end, error) else error end as error) from o{d}),
s{d} as (select e.id, case e.task_index when 2 then g.c2 when 3 then g.c3 else e.st end as status, case e.task_index when 2 then g.r2 when 3 then g.r3 else e.res end as result, e.summ as summary, e.task_index, e.workflow_id from e{d} e join g{d} g on g.id = e.workflow_id),
p{d} as (select parent_workflow_id, parent_task_index, case when status = 'COMPLETED' then 'COMPLETED' else 'FAILED' end, case when status = 'COMPLETED' then result else {child} end, summary from (select *, {summary} as summary from g{d} where go and parent_workflow_id is not null))"""


_TREE = "".join(_level(d) for d in _LEVELS)
_TABLES = ("tree_workflows", "tree_nodes", "tree_outcomes")
_META = """concat('"__workflow_meta__":{"workflow_id":"', s.workflow_id, '","task_index":', s.task_index, ',"task_name":"fn_', s.task_index, '"}')"""
ORACLES = {
    "complete_tree": oracle(_TREE + " union all ".join(f" select 'workflow' as kind, id, status, result, error, null as summary from g{d} union all select 'node', id, status, result, null, summary from s{d}" for d in _LEVELS), *_TABLES),
    "tree_tasks": oracle(
        _TREE + ", s as (" + " union all ".join(f"select * from s{d}" for d in _LEVELS) + f""") select concat(s.workflow_id, '/', s.task_index) as id, concat('fn_', s.task_index) as task_name, case when x.task_options is null then 0 else 3 end as max_retries, 'PENDING' as status, {NOW} as sent_at,
  concat('{{', concat_ws(',', case when x.task_kwargs is not null then '"d0":1' end, case when s.task_index = 2 and cast(substr(s.workflow_id, 4) as bigint) % 2 = 1 and z.status in {_ENDED} then concat('"d0":{{"__injected_result__":true,"data":', to_json({X.seen("z.status", "z.result", "0", "z.workflow_id")}), '}}') end, {_META}), '}}') as kwargs
  from s join tree_nodes x on x.id = s.id left join s z on z.workflow_id = s.workflow_id and z.task_index = 0 where s.status = 'ENQUEUED'""",
        *_TABLES,
    ),
}
