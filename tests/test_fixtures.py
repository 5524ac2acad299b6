"""Derived tables over wide ranges of keys, where instants lie tens of thousands of years back."""

from __future__ import annotations

import shutil
from pathlib import Path

import duckdb
import pytest

import __spark_entry__


@pytest.mark.parametrize("query", ["active_workers", "append_snapshots", "stream_worker_feed"])
def test_instants_of_six_million_events(spark, tmp_path, query):
    """The oldest of 6,000,000 events lies 1.2e12 seconds back, which no interval of decimal(18,6) seconds holds."""
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        shutil.copyfile(path, tmp_path / path.name)
    con = duckdb.connect()
    con.execute(f"copy (select r.e::bigint as event_id, r.e::bigint % 7 as user_id, 'view' as event_type, '{{}}' as props from (values (5), (6), (9), (3000000), (5999990), (5999999)) r(e)) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    found = __spark_entry__.queries()[query](spark, str(tmp_path))
    con.execute(f"create table expected as {__spark_entry__.oracle_sql()[query]}")
    names = [r[0] for r in con.execute("describe expected").fetchall()]
    times = {n for n, kind in found.dtypes if kind == "timestamp_ntz"}
    # Python has no dates before year 1: instants are compared as text of microseconds.
    micros = found.selectExpr(*[f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{n}`) as `{n}`" if n in times else f"`{n}`" for n in names])
    expected = con.execute("select " + ", ".join(f'epoch_us("{n}")' if n in times else f'"{n}"' for n in names) + " from expected").fetchall()
    assert expected and sorted(map(repr, (tuple(r) for r in micros.collect()))) == sorted(map(repr, expected))


WORKERS = "cluster_capacity dead_workers load_scale overloaded_workers retention_worker_states search_workers snapshot_age search_alerts stale_claims stream_latest_worker stream_trend utilization_trend worker_load worker_load_one worker_queues".split()


@pytest.mark.parametrize("query", WORKERS)
def test_every_query_on_workers_has_such_instants(spark, tmp_path, query):
    """Rows are as many as those of the SQL; of values, dead_workers' seconds are compared as well."""
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        shutil.copyfile(path, tmp_path / path.name)
    con = duckdb.connect()
    con.execute(f"copy (select r.e::bigint as event_id, r.e::bigint % 7 as user_id, 'view' as event_type, '{{}}' as props from (values (5), (6), (9), (3000001), (5999990), (5999999)) r(e)) to '{tmp_path}/events.parquet'")
    for name in ("events", "orders"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    expected = con.execute(f"select count(*) from ({__spark_entry__.oracle_sql()[query]})").fetchone()[0]
    found = __spark_entry__.queries()[query](spark, str(tmp_path))
    # Spark counts no more than it needs to: a written table evaluates every column.
    found.write.parquet(str(tmp_path / "found"))
    assert con.execute(f"select count(*) from '{tmp_path}/found/*.parquet'").fetchone()[0] == expected
    if query == "dead_workers":
        rows = con.execute(f"select worker_id, offline_seconds from ({__spark_entry__.oracle_sql()[query]}) order by 1").fetchall()
        assert con.execute(f"select worker_id, offline_seconds from '{tmp_path}/found/*.parquet' order by 1").fetchall() == rows
