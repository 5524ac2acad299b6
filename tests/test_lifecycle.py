"""Helpers that no query compares: connection delays, tagged values, Parquet round trip, registry, clearing of folders."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from queuelens import schemas
from queuelens.functions import retry, schedule, tagged, udfs
from queuelens.operators import lifecycle, transitions
from queuelens.sources import shared, tables

SF = "/root/testdata/sf0.001"


def test_reconnect_delays_double_up_to_a_limit():
    assert [retry.reconnect_delay(n) for n in (0, 1, 3, 10)] == [1.0, 2.0, 8.0, 60.0]
    assert retry.reconnect_delay(0, first=0.01) == 0.1 and retry.reconnect_delay(2, jitter=-0.25) == 3.0


def test_unknown_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="lacks result"):
        transitions.update(spark.range(1), F.lit(True), {"result": F.lit("x")})


def test_tables_survive_parquet(spark, tmp_path):
    t = tables.from_fixtures(spark, SF)
    tables.write(t, f"file://{tmp_path}/t")
    back = tables.from_parquet(spark, f"file://{tmp_path}/t", t.as_of)
    for name in tables.NAMES:
        old, new = getattr(t, name), getattr(back, name)
        assert old.exceptAll(new.select(old.columns)).count() == 0 and old.count() == new.count()
    days = [d for d in os.listdir(tmp_path / "t" / "heartbeats") if d.startswith("day=")]
    assert days


def test_a_name_has_one_function():
    udfs.column("twice", abs)
    with pytest.raises(ValueError):
        udfs.column("twice", len)


def test_tagged_results(spark):
    df = spark.createDataFrame([("1", None), (None, '{"error_code":"X"}')], "ok string, err string")
    rows = df.select(tagged.decode_result(tagged.encode_result(F.col("ok"), F.col("err"))).alias("r")).collect()
    assert rows[0].r.ok == "1" and rows[1].r.err == '{"error_code":"X"}'


def test_inserted_rows_count_once(spark):
    old = spark.createDataFrame([("a", 1)], "id string, n int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "id string, n int")
    assert sorted(map(tuple, lifecycle.insert(old, new).collect())) == [("a", 1), ("b", 3)]


def test_folders_can_be_cleared(spark):
    since = shared.mark(spark)
    first, second = shared.written(spark.range(3), "a"), shared.written(spark.range(4), "b")
    assert first.count() == 3
    shared.clear(spark, since, keep=1)
    assert second.count() == 4 and shared.mark(spark) == since + 1
    with pytest.raises(Exception, match="(?i)not.*exist|file"):
        first.count()


def test_a_scope_clears_only_its_own_folders(spark):
    before = shared.written(spark.range(2), "other")
    count = shared.mark(spark)
    with shared.scope():
        assert shared.mark(spark) == 0
        mine = shared.written(spark.range(3), "mine")
        kept = shared.written(spark.range(4), "kept")
        shared.clear(spark, 0, keep=1)
    assert before.count() == 2 and kept.count() == 4 and shared.mark(spark) == count + 1
    with pytest.raises(Exception, match="(?i)not.*exist|file"):
        mine.count()


def test_tables_are_read_from_a_database(spark, tmp_path):
    """An embedded database; heartbeats are read in parallel by id."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    t = tables.from_fixtures(spark, SF)
    plain = {
        "tasks": t.tasks.select("id", "status"), "task_attempts": t.task_attempts.select("task_id", "attempt"), "schedule_state": t.schedule_state.select("schedule_name", "run_count"),
        "workflows": t.workflows.select("id", "status"), "workflow_tasks": t.workflow_tasks.select("id", "workflow_id"), "worker_states": t.worker_states.select("id", "worker_id"),
        "heartbeats": t.heartbeats.limit(500).select(F.monotonically_increasing_id().alias("id"), "task_id"),
    }
    for name, df in plain.items():
        df.write.format("jdbc").options(url=url, dbtable=f"q_{name}", **options).mode("append").save()
    back = tables.from_jdbc(spark, url, t.as_of, prefix="q_", partitions=3, **options)
    for name, df in plain.items():
        assert getattr(back, name).count() == df.count()
    assert back.heartbeats.rdd.getNumPartitions() > 1


def test_attempts_of_a_database_without_them(spark):
    t = tables.from_fixtures(spark, SF)
    empty = schemas.upgrade_attempts(None, t.tasks, t.as_of)
    assert empty.count() == 0 and empty.columns == [f.name for f in schemas.TASK_ATTEMPTS]


def test_appended_rows_keep_the_table_s_columns(spark):
    old = spark.createDataFrame([(1, "a")], "id long, kind string")
    new = spark.createDataFrame([(2, "x")], "id int, other string")
    assert sorted(map(tuple, lifecycle.append(old, new).collect()), key=str) == [(1, "a"), (2, None)]


def test_hash_of_settings_is_that_of_their_stored_form(spark):
    import hashlib

    text = '{"pattern":{"type":"weekly","days":["monday"],"time":{"__time__":true,"value":"09:05:00"}},"timezone":"UTC"}'
    assert schedule.config_hash(schedule.Weekly(("monday",), 9, 5), "UTC") == hashlib.sha256(text.encode()).hexdigest()
    for pattern in (schedule.Interval(30), schedule.Hourly(5), schedule.Daily(3), schedule.Weekly(("monday",), 9, 5), schedule.Monthly(31, 6, 0, 1)):
        row = spark.range(1).select(schedule.config_hash_of(schedule.pattern_of(pattern), F.lit("Europe/Berlin")).alias("h")).first()
        assert row.h == schedule.config_hash(pattern, "Europe/Berlin")
