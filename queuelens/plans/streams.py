"""Streaming jobs and user functions by name. Each stream runs over all that is available and equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.functions import udfs
from queuelens.operators import lifecycle
from queuelens.plans.lifecycle import REAPED, equipped
from queuelens.sources.fixtures import AS_OF, oracle
from queuelens.sources.shared import shared_dir
from queuelens.sources.tables import Tables
from queuelens.streaming import jobs, state


def stream_of(df: DataFrame, name: str) -> DataFrame:
    """A file stream of the rows of a batch frame, written to the shared folder."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _run(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    root = shared_dir(df.sparkSession, name)
    return jobs.drain(df, f"{root}/checkpoint", f"{root}/out", mode)


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def stream_trend(t: Tables) -> DataFrame:
    states = jobs.zoned(t.worker_states.select("id", "snapshot_at", "tasks_running", "processes"), "snapshot_at")
    return _plain(_run(jobs.trend(stream_of(states, "snapshots")), "trend", "complete"), "minute")


def stream_latest_worker(t: Tables) -> DataFrame:
    states = t.worker_states.select("id", "worker_id", "hostname", "tasks_running", "tasks_claimed", "snapshot_at")
    return _run(jobs.latest_worker(stream_of(states, "snapshots")), "latest", "complete")


def _in_parts(parts, name: str, job) -> DataFrame:
    """The result of a stream over `parts`, one after the other: it is stopped and started again between them."""
    spark = parts[0].sparkSession
    path, root = shared_dir(spark, name), shared_dir(spark, name)
    for part in parts:
        part.write.mode("append").parquet(path)
        out = jobs.drain(job(spark.readStream.schema(parts[0].schema).parquet(path)), f"{root}/checkpoint", f"{root}/out")
    return out


def stream_liveness(t: Tables) -> DataFrame:
    beats = jobs.zoned(t.heartbeats.filter("role = 'runner'").select("task_id", "sent_at"), "sent_at")
    # First all beats, then one a day later, after which all other tasks are silent.
    later = beats.sparkSession.sql(f"select 'later' as task_id, TIMESTAMP '{AS_OF}' + interval 1 day as sent_at")
    return _plain(_in_parts([beats, later], "liveness", state.liveness), "last_seen")


def stream_transitions(t: Tables) -> DataFrame:
    """Tasks as they are sent, then as expiry leaves them: a row that has not changed gives no message."""
    from queuelens.operators.transitions import expire_pending

    old = equipped(t).tasks.select("id", "status", "queue_name", "good_until", "failed_at", "error_code", "result", "updated_at")
    new = expire_pending(old.withColumn("updated_at", t.as_of), t.as_of).drop("changed")
    parts = [jobs.zoned(x.select("id", "status", "queue_name", "updated_at"), "updated_at") for x in (old, new)]
    return _plain(state.messages(_in_parts(parts, "transitions", state.transitions), "task"), "at")


def stream_workflow_feed(t: Tables) -> DataFrame:
    flows = t.workflows.select("id", "status", "updated_at")
    paused = flows.withColumns({"status": F.when(F.col("status") == "RUNNING", "PAUSED").otherwise(F.col("status")), "updated_at": t.as_of})
    parts = [jobs.zoned(x, "updated_at") for x in (flows, paused)]
    return _plain(state.messages(_in_parts(parts, "transitions", state.transitions), "workflow"), "at")


def stream_enqueued(t: Tables) -> DataFrame:
    """All tasks, then each of them again: with the same content, with another, or under another id."""
    sent = jobs.zoned(t.tasks.select("id", F.md5("task_name").alias("enqueue_sha"), F.col("enqueued_at").alias("sent_at")), "sent_at")
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 3
    again = sent.select(F.when(n == 0, F.concat("id", F.lit("-new"))).otherwise(F.col("id")).alias("id"), F.when(n == 1, F.md5("id")).otherwise(F.col("enqueue_sha")).alias("enqueue_sha"), (F.col("sent_at") + F.expr("interval 1 hour")).alias("sent_at"))
    return _in_parts([sent, again], "enqueued", state.enqueued).select("id", "enqueue_sha", "verdict")


def stream_due_messages(t: Tables) -> DataFrame:
    """Waiting tasks, then a row a hundred seconds on: by then some of their messages are due."""
    tasks = t.tasks.select("id", "status", "queue_name", "next_retry_at", t.as_of.alias("updated_at"))
    later = tasks.sparkSession.sql(f"select 'later' as id, 'RUNNING' as status, 'q' as queue_name, cast(null as timestamp_ntz) as next_retry_at, TIMESTAMP_NTZ '{AS_OF}' + interval 100 seconds as updated_at")
    parts = [jobs.zoned(x, "next_retry_at", "updated_at") for x in (tasks, later)]
    return _plain(_in_parts(parts, "due", state.due_messages), "deliver_at")


def stream_reaper(t: Tables) -> DataFrame:
    tasks = equipped(t).tasks
    root = shared_dir(tasks.sparkSession, "reaper")
    ticks = stream_of(tasks.sparkSession.sql(f"select TIMESTAMP_NTZ '{AS_OF}' as at"), "ticks")
    last = jobs.reaper(ticks, tasks, t.heartbeats, lifecycle.reap, f"{root}/state", f"{root}/checkpoint")
    return tasks.sparkSession.read.schema(tasks.schema).parquet(last).select("id", "status", "retry_count", "claimed_by_worker_id", "error_code")


def stream_worker_feed(t: Tables) -> DataFrame:
    states = jobs.zoned(t.worker_states.select("worker_id", "snapshot_at"), "snapshot_at")
    return _plain(_run(jobs.row_feed(stream_of(states, "snapshots"), "worker_state", "worker_id", "snapshot_at"), "feed"), "at")


def stream_change_feed(t: Tables) -> DataFrame:
    tasks = jobs.zoned(t.tasks.select("id", "status", "queue_name", "enqueued_at"), "enqueued_at")
    return _plain(_run(jobs.change_feed(stream_of(tasks, "tasks")), "feed"), "at")


def stream_deduplicated(t: Tables) -> DataFrame:
    beats = jobs.zoned(t.heartbeats.select("task_id", "sent_at"), "sent_at")
    return _run(jobs.deduplicated(stream_of(beats, "heartbeats"), "task_id", "sent_at"), "once").select("task_id")


def weighed(retries: int, priority: int) -> int | None:
    """The example task: fails for tasks without retries, returns nothing for the lowest priorities."""
    if retries == 0:
        raise ZeroDivisionError("no retries")
    return None if priority > 95 else priority // retries


def task_udf(t: Tables) -> DataFrame:
    call = udfs.column("weighed", weighed, codes={"ZeroDivisionError": "DIVISION"})
    result = t.tasks.select("id", call(F.col("retry_count"), F.col("priority")).alias("r"))
    return result.select("id", F.col("r.ok").alias("ok"), F.col("r.err.code").alias("code"))


QUERIES = {
    "stream_trend": stream_trend,
    "stream_latest_worker": stream_latest_worker,
    "stream_liveness": stream_liveness,
    "stream_transitions": stream_transitions,
    "stream_workflow_feed": stream_workflow_feed,
    "stream_enqueued": stream_enqueued,
    "stream_due_messages": stream_due_messages,
    "stream_reaper": stream_reaper,
    "stream_change_feed": stream_change_feed,
    "stream_worker_feed": stream_worker_feed,
    "stream_deduplicated": stream_deduplicated,
    "task_udf": task_udf,
}
_ROUNDED = "cast(round(cast(avg(tasks_running::double / nullif(processes::double, 0)) * 100 as decimal(38,10)), 2) as double)"
ORACLES = {
    "stream_trend": oracle(f" select date_trunc('minute', snapshot_at) as minute, {_ROUNDED} as avg_utilization_pct, cast(sum(tasks_running) as bigint) as total_running, cast(sum(processes) as bigint) as total_capacity from worker_states group by 1", "worker_states"),
    "stream_latest_worker": oracle(" select worker_id, hostname, tasks_running, tasks_claimed, snapshot_at from worker_states qualify row_number() over (partition by worker_id order by snapshot_at desc, id desc) = 1", "worker_states"),
    "stream_liveness": oracle(f", seen as (select task_id, max(sent_at) as last_seen from heartbeats where role = 'runner' group by 1) select *, true as alive from seen union all select *, false from seen union all select 'later', TIMESTAMP '{AS_OF}' + interval 1 day, true", "heartbeats"),
    "stream_transitions": oracle(f", e as (select id, queue_name, status, case when status = 'PENDING' and good_until <= TIMESTAMP '{AS_OF}' then 'EXPIRED' else status end as after, enqueued_at from tasks) select unnest(case when status = 'PENDING' then ['task_status', 'task_new', concat('task_queue_', queue_name)] else ['task_status'] end) as channel, id as payload, null as was, status, enqueued_at as at from e union all select unnest(['task_status', 'task_done']), id, 'PENDING', 'EXPIRED', TIMESTAMP '{AS_OF}' from e where after <> status", "tasks"),
    "stream_workflow_feed": oracle(f" select 'workflow_status' as channel, id as payload, null as was, status, updated_at as at from workflows union all select unnest(['workflow_status', 'workflow_done']), id, 'RUNNING', 'PAUSED', TIMESTAMP '{AS_OF}' from workflows where status = 'RUNNING'", "workflows"),
    "stream_enqueued": oracle(", n as (select id, task_name, cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) % 3 as n from tasks) select id, md5(task_name) as enqueue_sha, 'new' as verdict from n union all select case when n = 0 then concat(id, '-new') else id end, case when n = 1 then md5(id) else md5(task_name) end, case n when 0 then 'new' when 1 then 'mismatch' else 'same' end from n", "tasks"),
    "stream_due_messages": oracle(f" select concat('task_queue_', queue_name) as channel, id as payload, next_retry_at as deliver_at from tasks where status = 'PENDING' and next_retry_at <= TIMESTAMP '{AS_OF}' + interval 100 second", "tasks"),
    "stream_reaper": REAPED.format(more=""),
    "stream_worker_feed": oracle(" select 'worker_state' as channel, worker_id as payload, snapshot_at as at from worker_states", "worker_states"),
    "stream_change_feed": oracle(" select unnest(case when status = 'PENDING' then ['task_status', 'task_new', concat('task_queue_', queue_name)] when status in ('COMPLETED', 'FAILED', 'CANCELLED', 'EXPIRED') then ['task_status', 'task_done'] else ['task_status'] end) as channel, id as payload, enqueued_at as at from tasks", "tasks"),
    "stream_deduplicated": oracle(" select distinct task_id from heartbeats", "heartbeats"),
    "task_udf": oracle(" select id, case when retry_count > 0 and priority <= 95 then cast(priority // retry_count as bigint) end as ok, case when retry_count = 0 then 'DIVISION' when priority > 95 then 'TASK_RETURNED_NONE' end as code from tasks", "tasks"),
}
