"""Claims under caps equal a greedy loop; expired claims use no cap."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from queuelens import schemas
from queuelens.operators import claim as C
from queuelens.operators import health as H
from queuelens.operators import transitions as T

NOW = datetime(2024, 1, 31)
SCHEMA = "id string, queue_name string, task_name string, priority int, status string, enqueued_at timestamp_ntz, next_retry_at timestamp_ntz, good_until timestamp_ntz, claim_expires_at timestamp_ntz, claimed_by_worker_id string, retry_count int"



def whole(df):
    """With all columns that updates write."""
    return schemas.complete(df, schemas.TASKS, ST.TimestampNTZType())


def as_of():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


def task(i, queue="a", priority=5, status="PENDING", age=10, lease=None, worker=None, good=None, retry=None):
    shift = lambda s: None if s is None else NOW + timedelta(seconds=s)
    return (f"t{i}", queue, "f", priority, status, shift(-age), shift(retry), shift(good), shift(lease), worker, 0)


def test_allocation_equals_greedy(spark):
    rng = random.Random(3)
    for _ in range(4):
        tasks = [task(i, rng.choice("abc"), rng.randint(1, 3), rng.choice(["PENDING", "PENDING", "RUNNING", "CLAIMED"]), rng.randint(-5, 60), rng.choice([None, -30, 30])) for i in range(120)]
        limits = {"a": (1, 4, 30), "b": (2, 9, None), "c": (3, 6, 25)}
        total = rng.randint(3, 20)
        caps = spark.createDataFrame([(q, *v) for q, v in limits.items()], "queue_name string, queue_order int, cap int, max_concurrency int")
        got = {r.id for r in C.claim_allocation(spark.createDataFrame(tasks, SCHEMA), caps, as_of(), total).collect()}
        expected, left = set(), total
        for q, (_, cap, limit) in limits.items():
            busy = sum(t[1] == q and (t[4] == "RUNNING" or t[4] == "CLAIMED" and (t[8] is None or t[8] > NOW)) for t in tasks)
            room = min(cap, left, cap if limit is None else max(0, limit - busy))
            open_ = sorted((t for t in tasks if t[1] == q and (t[4] == "PENDING" or t[4] == "CLAIMED" and t[8] is not None and t[8] < NOW) and t[5] <= NOW), key=lambda t: (t[3], t[5], t[0]))
            expected |= {t[0] for t in open_[:room]}
            left -= len(open_[:room])
        assert got == expected


def test_bounds_are_strict(spark):
    df = spark.createDataFrame([task(1, good=0), task(2, good=1), task(3, status="CLAIMED", lease=0), task(4, status="CLAIMED", lease=-1), task(5, retry=0), task(6, retry=1), task(7, age=0)], SCHEMA)
    assert {r.id for r in df.filter(C.claimable(as_of())).collect()} == {"t2", "t4", "t5", "t7"}
    assert H.load_counts(df, as_of()).first().in_flight == 0


def test_claim_sets_lease(spark):
    df = whole(spark.createDataFrame([task(1), task(2, priority=1)], SCHEMA))
    caps = spark.createDataFrame([("a", 1, 1, None)], "queue_name string, queue_order int, cap int, max_concurrency int")
    out = {r.id: r for r in C.claim(df, C.claim_allocation(df, caps, as_of(), 5), as_of(), "w").collect()}
    assert out["t2"].status == "CLAIMED" and out["t2"].claim_expires_at == NOW + timedelta(seconds=60) and out["t1"].status == "PENDING"


def test_finalize_ignores_tasks_that_do_not_run(spark):
    df = whole(spark.createDataFrame([task(1, status="RUNNING"), task(2, status="COMPLETED")], SCHEMA))
    done = spark.createDataFrame([("t1", True, "{}", None, None), ("t2", False, "{}", "X", None)], "task_id string, ok boolean, result string, error_code string, failed_reason string")
    assert {r.id: (r.status, r.changed) for r in T.finalize(df, done, as_of()).collect()} == {"t1": ("COMPLETED", True), "t2": ("COMPLETED", False)}


def test_descendants_reach_all_levels(spark):
    flows = spark.createDataFrame([("a", "RUNNING", None, 0), ("b", "RUNNING", "a", 1), ("c", "RUNNING", "b", 2), ("d", "PAUSED", "a", 1), ("e", "RUNNING", "d", 2)], "id string, status string, parent_workflow_id string, depth int")
    assert {r.id for r in T.descendants(flows, F.col("id") == "a", "RUNNING").collect()} == {"a", "b", "c"}


def test_all_workers_claim_as_one_after_the_other(spark):
    rng = random.Random(11)
    for cluster_cap in (None, 40, 3):
        ids = [f"w{i}" for i in range(9)]
        tasks = [task(i, rng.choice("abcd"), rng.randint(1, 3), rng.choice(["PENDING", "PENDING", "PENDING", "RUNNING", "CLAIMED"]), rng.randint(-5, 60), rng.choice([None, -30, 30]), rng.choice([None, *ids])) for i in range(150)]
        limits = {"a": (1, 2, 30), "b": (2, 1, None), "c": (3, 3, 9), "d": (4, 50, None)}
        fleet = [(w, rng.randint(0, 20), rng.randint(0, 7), rng.choice([0, 0, 3]), rng.choice([0, 0, 2])) for w in ids]
        caps = spark.createDataFrame([(q, *v) for q, v in limits.items()], "queue_name string, queue_order int, cap int, max_concurrency int")
        workers = spark.createDataFrame(fleet, "worker_id string, worker_order int, processes int, prefetch int, max_claimed int")
        got = {(r.worker_id, r.id) for r in C.claims_of_workers(spark.createDataFrame(tasks, SCHEMA), workers, caps, as_of(), cluster_cap).collect()}
        active = lambda t: t[4] == "CLAIMED" and (t[8] is None or t[8] > NOW)
        open_ = sorted((t for t in tasks if (t[4] == "PENDING" or t[4] == "CLAIMED" and t[8] is not None and t[8] < NOW) and t[5] <= NOW), key=lambda t: (t[3], t[5], t[0]))
        expected, gone = set(), set()
        for w, _, processes, prefetch, held_most in sorted(fleet, key=lambda f: (f[1], f[0])):
            running, held = (sum(t[9] == w and f(t) for t in tasks) for f in (lambda t: t[4] == "RUNNING", active))
            budget = 0 if held >= (held_most or processes + prefetch) else max(0, processes + prefetch - running - (0 if prefetch else held))
            if cluster_cap is not None:
                budget = min(budget, max(0, cluster_cap - sum(t[4] == "RUNNING" or active(t) for t in tasks) - len(gone)))
            for q, (_, cap, limit) in limits.items():
                busy = sum(t[1] == q and (t[4] == "RUNNING" or active(t) or t[0] in gone) for t in tasks)
                room = min(cap, budget, cap if limit is None else max(0, limit - busy))
                mine = [t[0] for t in open_ if t[1] == q and t[0] not in gone][:room]
                expected |= {(w, i) for i in mine}
                gone |= set(mine)
                budget -= len(mine)
        assert got == expected


def test_no_queues_or_workers(spark):
    df = spark.createDataFrame([task(1)], SCHEMA)
    caps = spark.createDataFrame([("a", 1, 2, None)], "queue_name string, queue_order int, cap int, max_concurrency int")
    workers = spark.createDataFrame([("w", 1, 1, 0, 0)], "worker_id string, worker_order int, processes int, prefetch int, max_claimed int")
    assert C.claims_of_workers(df, workers, caps.limit(0), as_of()).count() == 0
    assert C.claims_of_workers(df, workers.limit(0), caps, as_of()).count() == 0
    assert C.claims_of_workers(df, workers, caps, as_of(), 0).count() == 0
