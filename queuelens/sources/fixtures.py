"""The seven tables, and trees of workflows, derived from the test data.

Each derivation is one SQL text; its placeholders have a Spark and a DuckDB
form, so that both engines compute the same rows by exact integer arithmetic.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

SQL = {
    "worker_states": """
        select event_id as id, concat('worker-', user_id) as worker_id, ago(idiv((m.mx - event_id) * (m.mx - event_id), 30)) as snapshot_at,
          concat('host-', user_id % 8) as hostname, cast(1000 + user_id as int) as pid, cast(user_id % 9 as int) as processes,
          cast((event_id * 7) % 9 as int) as tasks_running, cast((event_id * 13) % 23 as int) as tasks_claimed,
          case when event_type = 'error' then null else cast((event_id * 37) % 1000 as double) / 10 end as memory_percent,
          cast((event_id * 53) % 1000 as double) / 10 as cpu_percent, props as queue_priorities,
          ago(idiv((m.mx - event_id) * (m.mx - event_id), 30) + user_id * 3600) as worker_started_at
        from events cross join (select max(event_id) as mx from events) m""",
    "tasks": """
        select concat('task-', o_orderkey) as id, concat('fn_', o_custkey % 40) as task_name, o_orderpriority as queue_name, cast(1 + o_orderkey % 100 as int) as priority,
          case cast(o_orderkey % 10 as int) when 0 then 'PENDING' when 1 then 'CLAIMED' when 2 then 'RUNNING' when 3 then 'RUNNING' when 4 then 'FAILED'
            when 5 then 'CANCELLED' when 6 then 'EXPIRED' else 'COMPLETED' end as status,
          ago((o_orderkey % 5000) * 37) as enqueued_at, case when o_orderkey % 10 in (2, 3) then ago((o_orderkey % 1000)) end as started_at,
          case when o_orderkey % 7 = 0 then null else concat('worker-', o_custkey % 150) end as claimed_by_worker_id,
          case when o_orderkey % 10 = 1 then ago((o_orderkey % 240) - 120) end as claim_expires_at,
          case when o_orderkey % 4 = 0 then ago((o_orderkey % 600) - 300) end as good_until, cast(o_orderkey % 4 as int) as retry_count, cast(3 as int) as max_retries,
          case when o_orderkey % 10 = 4 then case when o_orderkey % 3 = 0 then 'TASK_EXCEPTION' else 'WORKER_CRASHED' end end as error_code,
          case when o_orderkey % 6 = 0 then ago((o_orderkey % 400) - 200) end as next_retry_at, case when o_orderkey % 10 >= 7 then ago((o_orderkey % 5000) * 30) end as completed_at,
          case when o_orderkey % 10 in (4, 6) then ago((o_orderkey % 5000) * 30) end as failed_at,
          concat('host-', o_custkey % 8) as worker_hostname, cast(1000 + o_custkey % 150 as int) as worker_pid from orders""",
    "heartbeats": """
        select concat('task-', l_orderkey) as task_id, case when l_linestatus = 'O' then 'runner' else 'claimer' end as role, concat('worker-', l_suppkey) as sender_id,
          ago((l_partkey * 31 + l_linenumber) % 1200) as sent_at from lineitem""",
    "workflows": """
        select concat('wf-', c_custkey) as id, c_mktsegment as name,
          case cast(c_custkey % 6 as int) when 0 then 'PENDING' when 1 then 'COMPLETED' when 2 then 'FAILED' when 3 then 'PAUSED' when 4 then 'CANCELLED' else 'RUNNING' end as status,
          ago(c_custkey * 20000 + 3600) as created_at, case when c_custkey % 6 in (1, 2, 4) then ago(c_custkey * 20000) end as completed_at, ago(c_custkey * 20000) as updated_at,
          case when c_custkey % 4 = 0 then 'pause' else 'fail' end as on_error, case when c_custkey % 8 = 0 then 0 end as output_task_index,
          case when c_custkey % 3 = 0 then '{"cases":[{"required_indices":[0,2]},{"required_indices":[1]}]}' end as success_policy,
          case when c_custkey % 6 = 1 then concat('wf-', c_custkey - 2) end as parent_workflow_id, case when c_custkey % 6 = 1 then 0 end as parent_task_index,
          case when c_custkey % 6 = 1 then 1 else 0 end as depth, concat('wf-', case when c_custkey % 6 = 1 then c_custkey - 2 else c_custkey end) as root_workflow_id
        from customer""",
    "workflow_tasks": """
        select concat('wt-', o_orderkey) as id, concat('wf-', o_custkey) as workflow_id, i as task_index, concat('n', i) as node_id, (i = 0 and o_custkey % 6 = 5) as is_subworkflow,
          case when o_custkey % 5 = 0 and o_orderkey % 7 < 4 then 'COMPLETED' else case cast(o_orderkey % 7 as int) when 0 then 'PENDING' when 1 then 'READY' when 2 then 'ENQUEUED'
            when 3 then 'RUNNING' when 4 then 'FAILED' when 5 then 'SKIPPED' else 'COMPLETED' end end as status,
          case when i = 0 then 0 when i % 2 = 1 then 1 else 2 end as n_deps, concat('task-', o_orderkey) as task_id,
          case when i = 0 then arr() when i % 2 = 1 then arr(i - 1) else arr(i - 2, i - 1) end as dependencies,
          case cast(o_orderkey % 3 as int) when 0 then 'all' when 1 then 'any' else 'quorum' end as join_type,
          case when o_orderkey % 3 = 2 then case when i = 0 then 0 when i % 2 = 1 then 1 else 2 end end as min_success, o_orderkey % 5 = 0 as allow_failed_deps,
          case when o_orderkey % 7 in (4, 6) and o_orderkey % 5 = 0 then concat('{"r":', o_orderkey, '}')
            when o_orderkey % 7 = 6 and o_orderkey % 5 = 1 then concat('{"ok":', o_orderkey, '}')
            when o_orderkey % 7 = 6 then concat('{"__task_result__":true,"ok":{"r":', o_orderkey, '},"err":null}')
            when o_orderkey % 7 = 4 and o_orderkey % 5 = 1 then '{"err":{"error_code":"OLD"}}' when o_orderkey % 7 = 4 and o_orderkey % 5 = 2 then '{"err":"text"}'
            when o_orderkey % 7 = 4 then concat('{"__task_result__":true,"ok":null,"err":{"__task_error__":true,"error_code":"E', o_orderkey % 3, '","data":{"n":', o_orderkey, '},"message":"no"}}') end as result
        from (select *, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as i from orders where o_custkey % 49 <> 0) x""",
    "task_attempts": """
        select concat('task-', l_orderkey) as task_id, cast(l_linenumber as int) as attempt,
          case min(l_returnflag) when 'A' then 'FAILED' when 'N' then 'COMPLETED' else 'WORKER_FAILURE' end as outcome, count(*) > 1 as will_retry,
          ago(min(l_partkey) % 5000 + 60) as started_at, ago(min(l_partkey) % 5000) as finished_at,
          case when min(l_returnflag) = 'A' then 'TASK_EXCEPTION' end as error_code, concat('worker-', min(l_suppkey)) as worker_id
        from lineitem group by l_orderkey, l_linenumber""",
    "schedule_state": """
        select s_name as schedule_name, ago(s_suppkey * 3600) as last_run_at, case when s_suppkey % 9 = 0 then null else ago((s_suppkey - 20) * 600) end as next_run_at,
          cast(s_suppkey % 13 as int) as run_count from supplier""",
    "tree_workflows": """
        select concat('tw-', n) as id, concat('flow', n % 4) as name, case when g % 7 = 3 and k = 2 then 'PAUSED' else 'RUNNING' end as status, case when n % 5 = 0 then 'pause' else 'fail' end as on_error,
          case when n % 4 = 1 then 3 end as output_task_index, case when n % 3 = 0 then '{"cases":[{"required_indices":[0,2]},{"required_indices":[1]}]}' end as success_policy,
          case when k > 0 then concat('tw-', 6 * g + case k when 3 then 1 when 4 then 3 when 5 then 2 else 0 end) end as parent_workflow_id, case when k = 0 then null when k in (2, 5) then 1 else 0 end as parent_task_index,
          case k when 0 then 0 when 3 then 2 when 4 then 3 when 5 then 2 else 1 end as depth, concat('tw-', 6 * g) as root_workflow_id, cast(null as string) as result, cast(null as string) as error
        from (select c_custkey as n, idiv(c_custkey, 6) as g, cast(c_custkey % 6 as int) as k from customer where c_custkey >= 6) x""",
    "tree_nodes": """
        select concat('tw-', n, '/', i) as id, concat('tw-', n) as workflow_id, i as task_index, concat('n', i) as node_id, concat('fn_', i) as task_name, 'main' as queue_name, 1 as priority, '[]' as task_args,
          case when i = 2 and n % 11 = 4 then '{"a' when i = 2 and n % 11 = 5 then '{"d0": 1}' end as task_kwargs, case when i = 3 and n % 11 = 6 then '[1]' when i = 3 and n % 11 = 7 then '{"retry_policy":{"intervals":[1]}}' end as task_options,
          sub as is_subworkflow, case when i >= 2 then 'PENDING' when sub or (n + i) % 4 > 0 then 'RUNNING' else 'COMPLETED' end as status, case when i < 2 and not sub then concat('tt-', n, '-', i) end as task_id,
          case when i < 2 then arr() when i = 2 then arr(0, 1) else arr(2) end as dependencies, case cast(n % 3 as int) when 0 then 'all' when 1 then 'any' else 'quorum' end as join_type,
          case when n % 3 = 2 then case when i = 2 then cast(n % 2 + 1 as int) else 1 end end as min_success, n % 4 < 2 as allow_failed_deps,
          case when i < 2 and not sub and (n + i) % 4 = 0 then concat('{"__task_result__":true,"ok":{"r":', n, '},"err":null}') end as result
        from (select n, i, (k = 0 and i < 2) or (k in (1, 3) and i = 0) or (k = 2 and i = 1) as sub
          from (select c_custkey as n, cast(c_custkey % 6 as int) as k from customer where c_custkey >= 6) c cross join (select 0 as i union all select 1 union all select 2 union all select 3) four) x""",
    "tree_outcomes": """
        select concat('tt-', n, '-', i) as task_id, (n + 2 * i) % 5 <> 4 as ok, case when (n + 2 * i) % 5 <> 4 then concat('{"__task_result__":true,"ok":', n, ',"err":null}')
          else '{"__task_result__":true,"ok":null,"err":{"__task_error__":true,"error_code":"E","data":null,"message":"no"}}' end as result
        from (select c_custkey as n, i from customer cross join (select 0 as i union all select 1) two where c_custkey >= 6) x where (n + 2 * i) % 5 > 0""",
}
_BASE = {
    "worker_states": "events", "tasks": "orders", "heartbeats": "lineitem", "workflows": "customer",
    "workflow_tasks": "orders", "task_attempts": "lineitem", "schedule_state": "supplier",
    "tree_workflows": "customer", "tree_nodes": "customer", "tree_outcomes": "customer",
}
_CALL = re.compile(r"\b(ago|idiv|arr)\(")


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose opening bracket ends at `at`, and where it ends."""
    out, depth, start = [], 1, at
    for i in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0 or depth == 1 and text[i] == ",":
            out.append(text[start:i].strip())
            start = i + 1
        if depth == 0:
            return [x for x in out if x], i + 1
    raise ValueError("unbalanced brackets")


def render(text: str, duck: bool) -> str:
    """A derivation in the SQL of DuckDB or of Spark."""
    while m := _CALL.search(text):
        given, end = _arguments(text, m.end())
        if m[1] == "idiv":
            new = f"(({given[0]}) {'//' if duck else 'div'} ({given[1]}))"
        elif m[1] == "arr":
            new = f"cast({'[' if duck else 'array('}{', '.join(given)}{']' if duck else ')'} as {'int[]' if duck else 'array<int>'})"
        elif duck:
            new = f"(TIMESTAMP '{AS_OF}' - to_seconds({given[0]}))"
        else:
            # As DuckDB's to_seconds, which takes a double; make_dt_interval takes no more than twelve digits of seconds.
            new = f"timestampadd(MICROSECOND, -cast(cast({given[0]} as double) * 1000000 as bigint), TIMESTAMP_NTZ '{AS_OF}')"
        text = text[: m.start()] + new + text[end:]
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables."""
    base = spark.read.parquet(f"{sf_dir}/{_BASE[name]}.parquet")
    return spark.sql(_bound(name), base=base)


def _bound(name: str) -> str:
    """The Spark text with the base table as a parameter; literal braces are doubled."""
    text = render(SQL[name], duck=False).replace("{", "{{").replace("}", "}}")
    return re.sub(rf"\bfrom {_BASE[name]}\b", "from {base}", text)


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL: `body` over the derived tables that it names."""
    return "with " + ", ".join(f"{n} as ({render(SQL[n], duck=True)})" for n in names) + body
