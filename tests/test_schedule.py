"""Next runs around clock changes and short months."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from queuelens.functions import schedule as S

NY = "America/New_York"
CASES = [
    (S.Monthly(31), "2025-02-01 00:00:00", "UTC", "2025-03-31 00:00:00"),
    (S.Monthly(30), "2025-01-31 00:00:00", "UTC", "2025-03-30 00:00:00"),
    (S.Daily(2, 30), "2025-03-09 06:00:00", NY, "2025-03-10 06:30:00"),
    (S.Weekly(("sunday",), 2, 30), "2025-03-08 12:00:00", NY, "2025-03-16 06:30:00"),
    (S.Monthly(9, 2, 30), "2025-03-01 12:00:00", NY, "2025-04-09 06:30:00"),
    (S.Daily(1, 30), "2025-11-02 04:59:00", NY, "2025-11-02 05:30:00"),
    # within the repeated hour a run never lies before the time it is computed from
    (S.Daily(1, 30), "2025-11-02 06:15:00", NY, "2025-11-03 06:30:00"),
    (S.Hourly(15), "2025-01-01 10:20:00", "UTC", "2025-01-01 11:15:00"),
    (S.Interval(90), "2025-01-01 10:20:00", "UTC", "2025-01-01 10:21:30"),
]


def at(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def instant(text):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


@pytest.mark.parametrize("pattern, start, tz, expected", CASES)
def test_next_run(spark, pattern, start, tz, expected):
    assert at(spark, S.next_run(pattern, instant(start), tz)) == datetime.fromisoformat(expected)


def test_missed_runs(spark):
    found = at(spark, S.missed_runs(S.Daily(3), instant("2025-01-01 03:00:00"), instant("2025-01-04 02:00:00"), 10))
    assert [d.day for d in found] == [1, 2, 3]
    found = at(spark, S.missed_runs(S.Interval(60), instant("2025-01-01 00:00:00"), instant("2025-01-01 01:00:00"), 5))
    assert len(found) == 5 and found[-1].minute == 4
    assert at(spark, S.missed_runs(S.Daily(3), instant("2025-01-05 03:00:00"), instant("2025-01-04 02:00:00"), 10)) == []


def test_tick_catches_up(spark):
    state = spark.sql("select 'a' as schedule_name, TIMESTAMP_NTZ '2024-12-31 03:00:00' as last_run_at, TIMESTAMP_NTZ '2025-01-01 03:00:00' as next_run_at, 4 as run_count")
    now = instant("2025-01-03 04:00:00")
    once = S.tick(state, S.Daily(3), now).first()
    assert (once.run_count, once.next_run_at.day) == (5, 4)
    many = S.tick(state, S.Daily(3), now, catch_up=2).first()
    # A pass counts once, however many slots it enqueues, and goes on from the last of them.
    assert (many.run_count, many.next_run_at.day, len(many.slots)) == (5, 3, 2)
    none = S.tick(state, S.Daily(3), now, catch_up=2, done=F.lit(0)).first()
    assert (none.run_count, none.next_run_at, none.last_run_at.year) == (4, state.first().next_run_at, 2024)


def test_config_hash_changes_with_pattern_and_zone():
    hashes = {S.config_hash(p, tz) for p in (S.Daily(3), S.Daily(4), S.Hourly(3)) for tz in ("UTC", "Europe/Berlin")}
    assert len(hashes) == 6 and S.config_hash(S.Daily(3), "UTC") in hashes
