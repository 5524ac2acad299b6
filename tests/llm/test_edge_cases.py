"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from queuelens.llm import bpe, html, jaccard, nndescent, packing, pii, quality, quotes, topk, warc
from queuelens.llm.common import shared_dir

LONG = "the quick brown fox jumps over it " * 4000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six", "en", "s1", 3), (2, None, None, None, None), (3, "", "en", "s1", 0), (None, "null id here", "en", None, 1), (5, LONG, "en", "s2", 9), (5, LONG, "en", "s2", 9), (1, "one two three four five six", "en", "s1", 3), (7, "  \n ", "en", "s1", 1)]
    clash = ["ids", "decoded", "score", "pii", "tokens", "queue", "cls", "size", "prefix", "u", "v", "id", "root", "begin", "part", "_gone"]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in clash}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, None), (5, 0, 1), (None, 1, 0), (3, None, 0)], "doc_id long, quality long, toxic long")


def test_bpe(docs):
    out = bpe.decode(bpe.encode(docs, P.path("byte_bpe_50k.json")), P.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.decoded for r in out.collect()} == {r.doc_id: r.text or "" for r in docs.collect()}
    assert out.count() == 8 and bpe.encode(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_decode_skips_unknown_ids_and_keeps_nulls(spark):
    df = spark.createDataFrame([([31373, -5, 99999, 995],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, P.path("byte_bpe_50k.json")).collect()] == ["hello world", None, ""]


def test_quality(docs, labels):
    model = quality.learn(docs, labels)
    scores = quality.score(docs, model).collect()
    assert len(scores) == 8 and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if not (r.text or "")}) == 1
    none = quality.score(docs, quality.learn(docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5} and quality.score(docs.limit(0), model).count() == 0


def test_packing(docs):
    path = P.path("byte_bpe_50k.json")
    out = packing.pack(docs, path, 1).collect()
    tokens = sum(r.n for r in bpe.encode(docs, path).select((F.size("ids") + 1).alias("n")).collect())
    assert sum(r.length for r in out) == tokens and all(len(r.ids) == 4 * r.length for r in out)
    assert packing.pack(docs.limit(0), path, 1).count() == 0


def test_pii(docs):
    assert pii.find(docs).count() == 8 and pii.find(docs.limit(0)).count() == 0


def test_jaccard(docs):
    got = jaccard.join(docs, 3, 90, 100).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert len(got) == 8 and by_id[2] == [(0, 2)] and by_id[3] == [(0, 3)] and by_id[None] == [(1, None)] and by_id[5] == [(7, 5)] * 2 and by_id[7] == [(0, 7)]
    assert jaccard.join(docs.limit(0), 3, 90, 100).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "user", None), (1, 1, "a", ""), (1, 1, "a", ""), (None, 0, "a", "x"), (1, None, "a", "> x"), (2, 0, None, LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(9)).withColumn("hash", F.lit(9))
    got = quotes.conversations(df)
    assert got.count() == 6 and quotes.conversations(df.limit(0)).count() == 0
    assert {(r.conv_id, r.turn): r.reply_to for r in got.collect()}[1, 1] == 0


def test_warc(spark):
    page = "<p>" + "x" * 200
    rows = [(1, "http://a/", page), (2, None, page), (3, "http://b/", None), (4, "http://c/\r\nX", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9), (1, "http://a/", page), (None, "http://d/", page), (6, "http://e/", "short"), (7, "http://f/", "short"), (8, "http://g/", LONG * 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2)).repartition(2)
    path = shared_dir(spark, "warc-test")
    warc.write(df, path)
    got = warc.assemble(warc.read(spark, path)).collect()
    found = sorted((r.metadata.fields["page-id"], r.response.type, r.response.refers_to) for r in got)
    assert found == sorted([("1", "response", None), ("1", "response", None), ("2", "revisit", "1"), ("", "revisit", "1"), ("3", "response", None), ("4", "response", None), ("6", "response", None), ("7", "response", None), ("8", "response", None)])
    payloads = {r.metadata.fields["page-id"]: bytes(r.response.payload) for r in got if r.response.type == "response"}
    assert payloads["4"] == rows[3][2].encode() and payloads["3"] == b"" and payloads["8"] == (LONG * 5).encode() and all(r.request is not None for r in got)
    empty = shared_dir(spark, "warc-test")
    warc.write(df.limit(0), empty)
    assert warc.assemble(warc.read(spark, empty)).count() == 0


def test_html(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a &amp; b"), (3, "<p>a &amp; b"), (4, "<div>" * 3000 + LONG)], "page_id long, html string").withColumn("text", F.lit("old"))
    got = [r.text for r in html.extract(df).orderBy("page_id").collect()]
    assert got[:4] == ["", "", "a & b", "a & b"] and got[4] == LONG.strip() and html.extract(df.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def test_topk(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (50, [0.0, 1.0], 1), (6, [1.0], 1), (1, [1.0, 0.5], 1), (None, [9.0, 9.0], 1), (7, [], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("v", F.lit(1)).withColumn("id", F.lit(1))
    got = [(r.query_id, r["rank"], r.id, r.score) for r in topk.search(df, "id % 50 = 0", 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 81920), (0, 2, 1, 81920), (0, 3, 6, 65536), (0, 4, 50, 32768), (0, 5, 7, 0), (50, 1, 0, 32768), (50, 2, 1, 32768), (50, 3, 1, 32768), (50, 4, 6, 0), (50, 5, 7, 0)]
    assert topk.search(df.limit(0), "id % 50 = 0", 5).count() == 0


def test_near_duplicates(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [0.0, 1.0], 1), (5, None, 1), (6, [0.0, 0.0], 1), (7, [None, 1.0], 1), (8, [float("nan"), 1.0], 1), (9, [], 1), (1, [1.0, 0.0], 1), (None, [0.0, -1.0], 1), (10, [3.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit(1)).withColumn("root", F.lit(1))
    got = sorted([(r.id, r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicates(df).collect()], key=str)
    linked = [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (10, 4, 1, False)]
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9)] + [(None, 0, None, False)]
    assert got == sorted(linked + alone, key=str)
    assert nndescent.near_duplicates(df.limit(0)).count() == 0
