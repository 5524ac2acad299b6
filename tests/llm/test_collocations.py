"""Collocations against a count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from queuelens.llm import collocations as C


def brute(rows, least: int, longest: int, top: int):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {g: c for g, c in f.items() if c >= least}
    out = {}
    for (lang, g), a in often.items():
        if len(g) < 2:
            continue
        inside = any(x == lang and len(h) > len(g) and c >= a and any(h[i : i + len(g)] == g for i in range(len(h))) for (x, h), c in often.items())
        if inside:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))  # noqa: E741
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def texts(seed: int):
    rng = random.Random(seed)
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(["a", "B", "b", "cé", "É", "d"]) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    return rows + [("en", "x y z w v. " * 9), ("en", None), ("fr", ""), ("fr", " . \n"), rows[0], rows[0]]


@pytest.mark.parametrize("limit", [C.NAMES, 12, 0])
def test_equals_brute_force(spark, limit):
    for seed, least, longest, top in ((1, 3, 5, 2000), (2, 5, 4, 7), (3, 1, 2, 50)):
        rows = texts(seed)
        docs = spark.createDataFrame([(t, lang, i) for i, (lang, t) in enumerate(rows)], "text string, lang string, word long")
        found = C.collocations(docs.repartition(3), least, longest, top, names_limit=limit)
        assert sorted(tuple(r) for r in found.collect()) == brute(rows, least, longest, top)


def test_words_that_share_a_key(spark, monkeypatch):
    monkeypatch.setattr(C, "_key", lambda data, start, end, lang: (end - start).astype(np.uint64))
    rows = texts(4)
    names = spark.createDataFrame([("en", "a", 0), ("en", "b", 1)], "lang string, word string, id long")
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert C.word_places(docs, names, True).read is None


def test_large_counts_are_exact(spark):
    big = 3_000_000_000
    level = "id long, left long, right long, lang string, phrase string, last string, f long, first_f array<long>, last_f array<long>"
    one = spark.createDataFrame([(0, None, None, "en", "a", "a", big, [], [])], level)
    two = spark.createDataFrame([(0, 0, 0, "en", "a a", "a", big - 7, [big], [big])], level)
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    assert C.scored([one, two], totals).first().score == 1000 * (big - 7) * 10**13 // big**2


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).count() == 0
    assert C.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        C.collocations(empty, longest=1)
