"""Every query with an oracle equals what DuckDB computes from the same files."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from queuelens.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return round(float(value), 9)
    return value


def rows(found, names):
    return sorted((tuple(plain(r[n]) for n in names) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    expected = [dict(zip(names, r)) for r in result.fetchall()]
    assert rows(found.collect(), sorted(names)) == rows(expected, sorted(names))


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
