"""Queries of the subpackage that SQL can express equal what DuckDB computes."""

from __future__ import annotations

import duckdb
import pytest

from queuelens.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    result = con.execute(catalog.oracle_sql()[name])
    names = sorted(d[0] for d in result.description)
    at = [[d[0] for d in result.description].index(n) for n in names]
    found = catalog.queries()[name](spark, SF)
    assert sorted(found.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
