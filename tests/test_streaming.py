"""Liveness over several micro-batches: heard of, silent, heard of again."""

from __future__ import annotations

from datetime import datetime, timedelta

from queuelens.streaming import jobs, state

T0 = datetime(2024, 1, 1)
SCHEMA = "task_id string, sent_at timestamp"


def test_silence_is_reported_by_event_time(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    stream = lambda: jobs.drain(state.liveness(spark.readStream.schema(SCHEMA).parquet(source), timeout=60, delay="0 seconds"), f"{tmp_path}/c", out)
    for rows in ([("a", T0), ("b", T0)], [("b", T0 + timedelta(seconds=200))], [("b", T0 + timedelta(seconds=400))]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        found = stream()
    got = {(r.task_id, r.alive) for r in found.collect()}
    assert ("a", True) in got and ("a", False) in got and ("b", True) in got


def test_batches_do_not_change_the_trend(spark, tmp_path):
    rows = [(i, f"w{i % 3}", T0 + timedelta(seconds=20 * i), i % 5, 4) for i in range(30)]
    schema = "id int, worker_id string, snapshot_at timestamp, tasks_running int, processes int"
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
    got = jobs.drain(jobs.trend(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")), f"{tmp_path}/c", f"{tmp_path}/out", "complete")
    assert sum(r.total_running for r in got.collect()) == sum(r[3] for r in rows) and got.count() == 10
