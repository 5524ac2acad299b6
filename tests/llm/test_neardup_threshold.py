"""Links at the threshold, in any number of dimensions, by any path; recall where links are rare."""

from __future__ import annotations

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.llm import nndescent as N


def pairs_at_nine_tenths(many: int) -> list[tuple[list[int], list[int]]]:
    """Pairs of vectors of small whole numbers whose cosine is exactly 0.9; their norms differ."""
    v = np.array(list(itertools.product(range(8), repeat=4)))[1:]
    dot, norm = v @ v.T, (v * v).sum(axis=1)
    i, j = np.nonzero((100 * dot * dot == 81 * np.outer(norm, norm)) & (norm[:, None] < norm))
    at = np.random.default_rng(2).choice(len(i), many, replace=False)
    return [(v[a].tolist(), v[b].tolist()) for a, b in zip(i[at], j[at])]


def planted(spark, pairs, shift: int):
    dim = 4 * len(pairs)
    rows = []
    for i, pair in enumerate(pairs):
        for j, x in enumerate(pair):
            v = [0.0] * dim
            v[4 * i : 4 * i + 4] = map(float, x)
            rows.append((2 * i + j + shift, v))
    return rows


@pytest.mark.parametrize("blocks", [False, True])
def test_pairs_at_the_threshold_link(spark, monkeypatch, blocks):
    pairs = pairs_at_nine_tenths(30)
    assert len(pairs) == 30
    rows = planted(spark, pairs, 0)
    con = duckdb.connect()
    wanted = {i for i, (x, y) in enumerate(pairs) if con.execute("select list_cosine_similarity(?::double[], ?::double[]) >= 0.9", [list(map(float, x)), list(map(float, y))]).fetchone()[0]}
    assert len(wanted) == 30
    if blocks:  # as if no descent had reached the recall: all nodes are compared in blocks
        monkeypatch.setattr(N, "ATTEMPTS", 0)
    got = {r.id: (r.n_links, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {2 * i + j: (1, 2 * i) for i in range(30) for j in (0, 1)}


@pytest.mark.parametrize("scale", [2.0**-560, 1.0, 2.0**530])
def test_lengths_of_vectors_do_not_matter(spark, scale):
    rows = [(i, [scale * p for p in v]) for i, v in planted(spark, pairs_at_nine_tenths(5), 0)]
    got = {r.id: r.n_links for r in N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got.values()) == {1}


@pytest.mark.parametrize("spiky", [False, True])
def test_many_components(spark, spiky):
    """Pairs at cosines from 0.9 to 0.92, in 4,096 components."""
    rng = np.random.default_rng(3)
    rows, wanted = [], {}
    for i in range(60):
        x, y = rng.standard_normal((2, 4096))
        if spiky:
            x[:2] *= 60
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        cosine = rng.uniform(0.9, 0.92) if i % 3 else rng.uniform(0.89, 0.8995)
        z = cosine * x + np.sqrt(1 - cosine**2) * y
        rows += [(2 * i, x.tolist()), (2 * i + 1, z.tolist())]
    m = np.array([r[1] for r in rows])
    sims = (m @ m.T) / np.sqrt(np.outer((m * m).sum(1), (m * m).sum(1)))
    np.fill_diagonal(sims, 0)
    wanted = {i: int((sims[i] >= 0.9).sum()) for i in range(len(rows))}
    got = {r.id: r.n_links for r in N.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    assert got == wanted


def test_half_precision_stays_within_the_margin():
    rng = np.random.default_rng(5)
    for dim in (8, 512, 8192):
        x = rng.standard_normal((50, dim)) * np.where(rng.random((50, dim)) < 0.01, 100, 1)
        u = N._normal(x)
        h = u.astype(np.float16).astype(np.float32)
        h /= np.linalg.norm(h, axis=1)[:, None]
        assert np.abs(h @ h.T - u @ u.T).max() < N.MARGIN


def test_rare_links_are_measured_by_independent_tables(spark):
    rng = np.random.default_rng(9)
    m = rng.standard_normal((400, 24))
    m[1] = m[0] + 0.01 * rng.standard_normal(24)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    nodes = N.nodes_of(vectors, "v")
    none = spark.createDataFrame([], "node long, n long"), spark.createDataFrame([], "node long, root long")
    recall, links = N.probe(nodes, *none, 24, 400, 10, 0.9)
    assert recall == 0 and links.count() == 1
    pair = links.first()
    known = spark.createDataFrame([(pair.u, 1), (pair.v, 1)], "node long, n long"), spark.createDataFrame([(pair.u, pair.u), (pair.v, pair.u)], "node long, root long")
    assert N.probe(nodes, *known, 24, 400, 10, 0.9)[0] == 1
    assert N.probe(nodes.join(links.select(F.col("v").alias("node")), "node", "left_anti"), *none, 24, 399, 10, 0.9)[0] == 1


def test_an_audit_that_sees_too_little_is_no_success(spark, monkeypatch):
    """Whatever the audit can't tell, the probe does; what it finds is linked in the end."""
    rng = np.random.default_rng(10)
    m = rng.standard_normal((600, 16))
    m[300:303] = m[0] + 0.02 * rng.standard_normal((3, 16))
    monkeypatch.setattr(N, "audit", lambda *_: None)
    monkeypatch.setattr(N, "descend", lambda graph, *_: graph.limit(0))
    whole = N.first_graph
    monkeypatch.setattr(N, "first_graph", lambda *a, **k: whole(*a, **k) if k.get("near_only") else whole(*a, **k).limit(0))
    got = {r.id: r.n_links for r in N.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")).collect()}
    assert {i for i, n in got.items() if n} == {0, 300, 301, 302} and got[0] == 3
