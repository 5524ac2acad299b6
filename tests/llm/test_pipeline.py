"""The whole pipeline against brute force, and its stages on odd rows; digests of whole queries against the library."""

from __future__ import annotations

import hashlib
import zlib

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from queuelens.llm import op1_bpe, op2_quality, pii
from queuelens.llm.common import table

SF = "/root/testdata/sf0.001"


def library(file):
    tokenizer = Tokenizer.from_file(P.path(file))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def shingles(text, n=5):
    words = [w for w in text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    good = [r.doc_id for r in op2_quality.op2_quality(spark, SF).filter("predicted = 1").collect()]
    sets, root = {d: shingles(docs[d].text or "") for d in good}, {d: d for d in good}
    for i, a in enumerate(good):
        for b in good[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    kept = [d for d in good if root[d] == d]
    lib = library("byte_bpe_50k.json")
    expected = {}
    for d in kept:
        plain, added = pii.spans(docs[d].text or "")
        expected[d] = len(lib.encode(pii.redact(docs[d].text or "", [*plain, *added]), add_special_tokens=False).ids) + 1
    rows = corpus_pipeline.run(spark, SF).collect()
    got = {}
    for r in rows:
        assert r.doc_tokens == expected[r.doc_id]
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == expected
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert all(filled[s] == 2048 for s in filled if s != max(filled))


def test_stages_on_odd_rows(spark):
    rows = [(1, "one two three four five six", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "mail a@b.cd please", "en", None, 5), (1, "one two three four five six", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("_score", "pii", "redacted", "_key", "_gone", "queue", "score")})
    for stage in (corpus_pipeline.keep_good, corpus_pipeline.keep_one, corpus_pipeline.redact):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
        if stage is corpus_pipeline.redact:
            assert [(r.text, r.n_chars) for r in out.filter("doc_id is null").collect()] == [("mail [EMAIL] please", 19)]
            assert out.count() == 5 and out.filter("text is null").count() == 1 and out.filter("pii <> 'x'").count() == 0
        if stage is corpus_pipeline.keep_one:
            assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 3]
    assert {(r.doc_id or 0) for r in corpus_pipeline.sequences(spark, docs, SF).collect()} == {0, 1, 2, 3}
    assert corpus_pipeline.sequences(spark, docs.limit(0), SF).count() == 0


def test_op1_digests(spark):
    lib = library("word_bpe_49k.json")
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    for r in op1_bpe.op1_bpe(spark, SF).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op2_rows(spark):
    rows = op2_quality.op2_quality(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
