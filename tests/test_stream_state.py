"""Stateful streams over several micro-batches and restarts: any split gives what a batch over all rows gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from queuelens.streaming import jobs, state

T0 = datetime(2024, 1, 1)
TASK = "id string, status string, queue_name string, next_retry_at timestamp, updated_at timestamp"


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def run(spark, root, parts, schema, job):
    """The stream is started anew for each part, with the same checkpoint."""
    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/in")
        out = jobs.drain(job(spark.readStream.schema(schema).parquet(f"{root}/in")), f"{root}/checkpoint", f"{root}/out")
    return out.collect()


@pytest.mark.parametrize("pieces", [1, 3])
def test_transitions_for_any_split(spark, tmp_path, pieces):
    rng = random.Random(pieces)
    rows = [(f"t{rng.randint(0, 5)}", rng.choice(["PENDING", "CLAIMED", "RUNNING"]), "q", None, at(i)) for i in range(60)]
    cut = [rows[len(rows) * k // pieces : len(rows) * (k + 1) // pieces] for k in range(pieces)]
    got = run(spark, tmp_path, cut, TASK, state.transitions)
    expected, last = [], {}
    for i, status, _, _, when in rows:
        if last.get(i) != status:
            expected.append((i, last.get(i), status, when))
        last[i] = status
    assert sorted((r.id, r.was or "", r.status, r.at) for r in got) == sorted((i, w or "", s, a) for i, w, s, a in expected)


def test_late_rows_and_nulls_change_nothing(spark, tmp_path):
    parts = [[("a", "PENDING", "q", None, at(10)), (None, "PENDING", "q", None, at(1)), ("b", None, "q", None, at(1)), ("c", "PENDING", "q", None, None)], [("a", "RUNNING", "q", None, at(5)), ("a", "PENDING", "q", None, at(11))], [("a", "RUNNING", "q", None, at(12))]]
    got = run(spark, tmp_path, parts, TASK, state.transitions)
    assert sorted((r.id, r.was, r.status) for r in got if r.was) == [("a", "PENDING", "RUNNING")] and len(got) == 2


@pytest.mark.parametrize("pieces", [1, 4])
def test_verdicts_for_any_split(spark, tmp_path, pieces):
    rng = random.Random(9)
    rows = [(f"t{rng.randint(0, 9)}", rng.choice("xyz"), at(i)) for i in range(40)]
    cut = [rows[len(rows) * k // pieces : len(rows) * (k + 1) // pieces] for k in range(pieces)]
    got = run(spark, tmp_path, cut, "id string, enqueue_sha string, sent_at timestamp", state.enqueued)
    first: dict = {}
    expected = [(i, sha, when, "new" if first.setdefault(i, (sha, when)) == (sha, when) else "same" if first[i][0] == sha else "mismatch") for i, sha, when in rows]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_messages_come_when_they_are_due(spark, tmp_path):
    """Moved, cancelled, due at once, and due while the stream was stopped."""
    parts = [
        [("a", "PENDING", "q", at(100), at(0)), ("b", "PENDING", "q", at(100), at(0)), ("c", "PENDING", "q", at(100), at(0)), ("d", "RUNNING", "q", at(50), at(0))],
        [("b", "RUNNING", "q", at(100), at(10)), ("c", "PENDING", "q", at(300), at(10)), ("a", "RUNNING", "q", None, at(-5))],
        [("x", "RUNNING", "q", None, at(150))],
        [("e", "PENDING", "r", at(120), at(151)), ("y", "RUNNING", "q", None, at(200))],
        [("z", "RUNNING", "q", None, at(301))],
    ]
    got = run(spark, tmp_path, parts, TASK, state.due_messages)
    assert sorted((r.channel, r.payload, r.deliver_at) for r in got) == [("task_queue_q", "a", at(100)), ("task_queue_q", "c", at(300)), ("task_queue_r", "e", at(120))]


def test_silence_and_return(spark, tmp_path):
    parts = [[("a", at(0)), ("b", at(0))], [("b", at(50)), ("b", at(20))], [("b", at(200))], [("a", at(201)), ("b", at(202))], [("z", at(500))]]
    got = run(spark, tmp_path, parts, "task_id string, sent_at timestamp", lambda df: state.liveness(df, timeout=60, delay="0 seconds"))
    of = {i: sorted((r.last_seen, r.alive) for r in got if r.task_id == i) for i in "ab"}
    assert of["a"] == [(at(0), False), (at(0), True), (at(201), False), (at(201), True)]
    assert (at(0), True) in of["b"] and (at(202), False) in of["b"]


def test_a_reaper_goes_on_from_its_last_round(spark, tmp_path):
    """Three ticks in three starts; each round works on what the one before left."""
    from pyspark.sql import functions as F

    tasks = spark.createDataFrame([("a", 0), ("b", 5)], "id string, n int")
    step = lambda before, _, as_of: before.withColumn("n", F.col("n") + F.second(as_of).cast("int"))
    for tick in (1, 10, 20):
        spark.createDataFrame([(at(tick),)], "at timestamp").write.mode("append").parquet(f"{tmp_path}/ticks")
        ticks = spark.readStream.schema("at timestamp").parquet(f"{tmp_path}/ticks")
        last = jobs.reaper(ticks, tasks, tasks, step, f"{tmp_path}/rounds", f"{tmp_path}/checkpoint")
    assert {r.id: r.n for r in spark.read.parquet(last).collect()} == {"a": 31, "b": 36}
    with pytest.raises(ValueError, match="no tick"):
        jobs.reaper(ticks, tasks, tasks, step, f"{tmp_path}/rounds", f"{tmp_path}/checkpoint")


@pytest.mark.parametrize("case", [test_messages_come_when_they_are_due, test_silence_and_return])
def test_keys_share_a_group_and_its_timer(spark, tmp_path, monkeypatch, case):
    monkeypatch.setattr(state, "GROUPS", 1)
    case(spark, tmp_path)
