"""Identifiers, fingerprints, retry delays and durations equal plain Python."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from queuelens import schemas
from queuelens.functions import ids, retry, times

TEXTS = ["plain", 'quo"te', "back\\slash", "line\nfeed\ttab\rret", "é ß 日本", "😀 end", "\x01\x7f", ""]


def test_json_text_equals_json_dumps(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    got = {r.t: r.j for r in df.select("t", ids.json_text(F.col("t")).alias("j")).collect()}
    assert got == {t: json.dumps(t) for t in [*TEXTS, None]}


def test_fingerprint(spark):
    value = spark.range(1).select(ids.fingerprint(ids.json_text(F.lit("a")), F.lit("5"), F.lit("null")).alias("h")).first().h
    assert value == hashlib.sha256(json.dumps(["a", 5, None], separators=(",", ":")).encode()).hexdigest()


def test_uuid5(spark):
    names = ["a", "nightly:2025-01-01T00:00:00.000000+00:00", "ü"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    space = uuid.UUID(ids.NAMESPACE)
    assert {r.n: r.u for r in df.select("n", ids.uuid5(F.col("n")).alias("u")).collect()} == {n: str(uuid.uuid5(space, n)) for n in names}


def test_advisory_key(spark):
    got = spark.range(1).select(ids.advisory_key(F.lit("x")).alias("k")).first().k
    assert got == int.from_bytes(hashlib.sha256(b"x").digest()[:8], "big", signed=True)


def test_retry_delay(spark):
    df = spark.createDataFrame([(1, [5, 9], "fixed"), (4, [5, 9], "fixed"), (3, [5], "exponential"), (2, None, None), (1, [0], "fixed")], "n int, i array<int>, s string")
    got = [r.d for r in df.select(retry.retry_delay(F.col("n"), F.col("i"), F.col("s")).alias("d")).collect()]
    assert got == [5.0, 9.0, 20.0, 300.0, 1.0]


def test_error_code(spark):
    code = retry.error_code({"KeyError": "GLOBAL", "OSError": "IO"}, F.col("c"), "OTHER", {"KeyError": "OWN"})
    df = spark.createDataFrame([("KeyError",), ("OSError",), ("X",)], "c string")
    assert [r.k for r in df.select(code.alias("k")).collect()] == ["OWN", "IO", "OTHER"]


def test_duration_text(spark):
    df = spark.createDataFrame([(None,), (0,), (59,), (185,), (7620,)], "s bigint")
    assert [r.d for r in df.select(times.duration_text(F.col("s")).alias("d")).collect()] == ["-", "0s", "59s", "3m 5s", "2h 7m"]


def test_upgrade_and_checks(spark):
    old = spark.createDataFrame([("a", "PENDING", 5, 0), ("b", "LOST", 500, -1)], "id string, status string, priority int, retry_count int")
    now = F.lit("2024-01-31").cast("timestamp")
    assert {r.enqueue_sha for r in schemas.upgrade_tasks(old, now).collect()} == {"legacy-pre-sha"}
    assert [(r.id, r.broken) for r in schemas.invalid(old).collect()] == [("b", ["status", "priority", "retry_count"])]


def test_tagged_values(spark):
    from queuelens.functions import tagged as G

    rows = [('{"__datetime__":true,"value":"2024-01-02T03:04:05+00:00"}',), ('{"__date__":true,"value":"2024-01-02"}',), ('{"__task_result__":true,"ok":{"a":1},"err":null}',), ("5",), ("not json",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    v = F.col("v")
    got = df.select(G.kind(v).alias("k"), G.as_timestamp(v).alias("t"), G.as_date(v).alias("d"), G.decode_result(v).alias("r")).collect()
    assert [r.k for r in got] == ["datetime", "date", "result", "plain", None, None]
    assert got[0].t.hour == 3 and got[1].d.day == 2 and got[2].r.ok == '{"a":1}' and got[3].r is None
    again = spark.range(1).select(G.decode_result(G.encode_result(F.lit("[1]"), F.lit(None).cast("string"))).alias("r")).first().r
    assert again.ok == "[1]" and again.err is None


def test_seconds_between_counts_new_seconds(spark):
    """As DuckDB's date_diff: parts of seconds make no difference, also before 1970."""
    row = spark.sql("select TIMESTAMP_NTZ '1960-01-01 00:00:00.000064' as a, TIMESTAMP_NTZ '2024-01-31 00:00:00' as b, TIMESTAMP_NTZ '2024-01-31 00:00:01.9' as c")
    assert tuple(row.select(times.seconds_between("a", "b"), times.seconds_between("b", "c"), times.seconds_between("c", "b")).first()) == (2_022_278_400, 1, -1)
