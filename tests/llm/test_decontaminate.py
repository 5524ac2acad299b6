"""Windows of items in documents against a search of every place."""

from __future__ import annotations

import random
import re

import pytest

from queuelens.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window: int):
    parts = [(i, tuple(w[a : a + min(window, len(w))])) for i, w in ((i, words(t)) for i, t in items) if w for a in range(len(w) - min(window, len(w)) + 1)]
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for item, part in parts:
            for a in range(len(w) - len(part) + 1):
                if tuple(w[a : a + len(part)]) == part:
                    hit |= set(range(a, a + len(part)))
                    met.add(None if item is None else str(item))
        out.append((doc_id, len(w), len(hit), sorted(x for x in met if x is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "shingle", "limit"), [(10, 5, 500_000), (4, 2, 500_000), (10, 5, 0), (3, 5, 3)])
def test_equals_brute_force(spark, monkeypatch, window, shingle, limit):
    monkeypatch.setattr(D, "BROADCAST_ROWS", limit)
    rng = random.Random(window)
    text = lambda n, some: "".join(rng.choice(some) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    few, more = ["a", "B", "é", "b"], ["a", "b", "c1", "É", "ß", "x", "Y", "z"]
    items = [(i, text(rng.randint(0, 25), more)) for i in range(12)] + [(100, "a b"), (101, "A"), (100, "é é é"), (102, None), (None, "x y z"), (103, "?!")]
    docs = [(i, text(rng.randint(0, 80), few if i % 3 else more)) for i in range(60)]
    docs += [(200 + i, text(3, more) + t + text(2, more)) for i, (_, t) in enumerate(items) if t] + [(1, None), (None, "a b"), docs[3], docs[3], (7, "")]
    found = D.contaminated(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, key string, w int").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window, shingle)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=repr) == brute(docs, items, window)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r) for r in D.contaminated(docs, items.limit(0)).collect()] == [(1, 2, 0, [])]
    assert D.contaminated(docs.limit(0), items).count() == 0


def test_functions_only(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = D.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
