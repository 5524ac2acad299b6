"""Runs of repeated words against a search of all stretches."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from queuelens.llm import runs
from queuelens.llm.op11_runs import planted


def brute(words: list, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, from its definition."""
    found = {}
    n = len(words)
    for p in range(1, n // times + 1):
        start = 0
        for i in range(n - p + 1):
            if i == n - p or words[i] != words[i + p]:
                if i - start + p >= max(least, times * p):
                    found.setdefault((start, i + p), p)
                start = i + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words: list, found: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (1, 2), (3, 3), (1, 5)])
def test_equals_brute_force(spark, monkeypatch, least, times):
    rng = random.Random(least * 10 + times)
    texts = []
    for _ in range(150):
        words = [rng.choice("ab") if rng.random() < 0.9 else rng.choice("cdé") for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
            at = rng.randint(0, len(words))
            words[at:at] = unit * rng.randint(2, 9) + unit[: rng.randint(0, len(unit))]
        texts.append(rng.choice(["", " "]) + rng.choice([" ", "\n", "\t \r"]).join(words))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in runs.runs(rows, least=least, times=times).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        want = brute(words, least, times)
        assert [tuple(x) for x in r.runs] == want, words
        assert r.n_words == len(words) and r.collapsed == collapsed(words, want)


def test_grid_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.tile(rng.integers(0, 3, k), 9) for k in (1, 2, 5, 30)])
    offsets = np.array([0, 9, 9, 100, len(x)])
    whole = runs.find(x, offsets, 6, 4)
    monkeypatch.setattr(runs, "GRID", 7)
    assert all((a == b).all() for a, b in zip(whole, runs.find(x, offsets, 6, 4), strict=True)) and len(whole[0])


def test_words_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(runs, "hashes", lambda data, start, end: (end - start).astype(np.uint64))
    data = np.frombuffer(b"aabbaabb", np.uint8)
    at = np.arange(0, 8, 2)
    number = runs._numbered(data, at, at + 2)
    assert number[0] == number[2] != number[1] == number[3]


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.StringType()), T.StructField("Text2", T.StringType())])
    long = "x y " * 50_000
    rows = [(1, None, "r", None), (None, "", None, "z"), (2, " \n\t", None, None), (3, "a " * 6, None, None), (3, "a " * 6, None, None), (4, "a " * 5, None, None), (5, long, None, None), (6, "é é é é é é", None, None)]
    found = runs.runs(spark.createDataFrame(rows, schema)).collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found] == [
        (0, [], ""), (0, [], ""), (0, [], ""), (6, [(0, 6, 1)], "a"), (6, [(0, 6, 1)], "a"), (5, [], "a a a a a"), (100_000, [(0, 100_000, 2)], "x y"), (6, [(0, 6, 1)], "é"),
    ]
    assert found[0].Text2 is None and found[1].Text2 == "z"
    assert runs.runs(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        runs.runs(spark.createDataFrame([], schema), times=1)


def test_planted_texts(spark):
    import zlib

    rows = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(300)] + [(None, "a b")], "doc_id long, text string")
    for r in planted(rows).collect():
        if r.doc_id is None:
            assert r.text == "a b"
            continue
        words = [f"w{j}" for j in range(r.doc_id % 40)]
        h, n = zlib.crc32(str(r.doc_id).encode()), r.doc_id % 40
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        assert r.text.split() == words
