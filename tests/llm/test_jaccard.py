"""Links between classes whose prefixes share very common tokens."""

from __future__ import annotations

import pytest

from queuelens.llm import jaccard


@pytest.mark.parametrize("limit", [jaccard.LIST, 7])
def test_long_lists_lose_no_link(spark, monkeypatch, limit):
    """Lists cut into second tokens and blocks give what one group gives: brute force over all pairs."""
    monkeypatch.setattr(jaccard, "LIST", limit)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(words[(i * k) % 12] for k in range(1, 3 + i % 5)) + f" x{i % 17} y{i % 9}" for i in range(120)]
    found = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1, 50, 100).collect()}
    sets = [set(t.split()) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 50 * len(a | b) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert found == dict(enumerate(root))


def test_a_token_in_many_prefixes(spark):
    """Two words are in all of 6,000 documents that are not alike, and in their prefixes."""
    n = 6_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('first second a', id, ' b', id) as text")
    docs = docs.unionByName(spark.sql(f"select {n}L as doc_id, 'first second a5 b5 c' as text"))
    found = jaccard.join(docs, 1, 34, 100)
    assert found.filter("component_id <> doc_id").collect()[0][:] == (n, 5, 5)
    assert found.filter("component_id <> doc_id").count() == 1


def test_long_lists_meet_shared_tokens_once(spark, monkeypatch):
    """Texts with one long line and a few words of their own, just not similar enough: their own words meet no list."""
    line = " ".join(f"line{i}" for i in range(36))
    rows = [(d, line + " " + " ".join(f"own{d}x{k}" for k in range(5 + d % 4))) for d in range(40)]
    made, write = [], jaccard.written
    monkeypatch.setattr(jaccard, "LIST", 8)
    monkeypatch.setattr(jaccard, "written", lambda df, name: (made.append(df.count()) if name == "jaccard-both" else None, write(df, name))[1])
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), n=5, num=80, den=100).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(d, d) for d, _ in rows]
    assert len(made) == 2 and 0 < made[1] <= made[0] <= 4 * len(rows)
