"""Packing with more sources than one schedule serves."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers

from queuelens.llm import bpe, packing
from queuelens.llm.op3_packing import END_ID, FILE


def test_many_sources_keep_their_shares():
    rng = np.random.default_rng(3)
    totals = rng.integers(1, 3000, 1500)
    totals[700] = 400_000
    tree = packing.Tree(totals, totals.astype(float), 256, 2048)
    assert tree.root is not None
    begin = np.zeros(len(totals), np.int64)
    doc, start, length, sequence, offset = tree.pieces(np.arange(len(totals)), begin, totals)
    assert (np.bincount(doc, length) == totals).all()
    order = np.lexsort((start, doc))
    ends = start[order] + length[order]
    same = doc[order][1:] == doc[order][:-1]
    assert (ends[:-1][same] == start[order][1:][same]).all()
    place = np.sort(sequence * 2048 + offset)
    ends = np.sort(sequence * 2048 + offset + length)
    assert place[0] == 0 and (ends[:-1] == place[1:]).all() and ends[-1] == totals.sum()
    # What a source has had, and what its share is of, never differ by more than a chunk for each queue of its group and of the root.
    order = np.argsort(sequence * 2048 + offset)
    upto, own = np.cumsum(length[order]), np.cumsum(np.where(doc[order] == 700, length[order], 0))
    assert np.abs(own - upto * totals[700] / totals.sum()).max() < 2 * 39 * 256


def test_a_task_sees_the_same_places():
    totals = np.full(1500, 700)
    tree = packing.Tree(totals, totals.astype(float), 256, 2048)
    whole = tree.pieces(np.arange(1500), np.zeros(1500, np.int64), totals)
    part = tree.pieces(np.arange(100, 120), np.full(20, 300), np.full(20, 400))
    places = {(d, s + i): q * 2048 + o + i for d, s, n, q, o in zip(*(x.tolist() for x in whole)) for i in range(n)}
    for d, s, n, q, o in zip(*(x.tolist() for x in part)):
        assert all(places[d + 100, 300 + s + i] == q * 2048 + o + i for i in range(n))


def test_sources_keep_their_names(spark):
    rows = [(i, f"word {i} and {i * 7}", f"source-{i % 1500}") for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), public_tokenizers.path(FILE), END_ID).toPandas()
    assert set(got["queue"]) == {r[2] for r in rows}
    first = got.sort_values(["doc_id", "start"]).groupby("doc_id")["length"].sum()
    assert (first == got.groupby("doc_id")["doc_tokens"].max()).all()
    filled = got.groupby("sequence_id")["length"].sum()
    assert (filled.iloc[:-1] == 2048).all()


def test_texts_cut_by_arrow_have_the_ids_of_the_library():
    """Pieces between spaces, runs of any white space, odd separators, characters of all widths, special tokens and nulls."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = bpe.Bpe(path), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    parts = [*" " * 8, *"\n\n\n", *"ab'sé²1,.…ß一", "\t", "\r", "\x0b", "\x85", "\xa0", "　", "\x1c", "​", "it's", *own.special]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(20_000)] + [None, "", " ", "   a", "a   ", "a" * 5000]
    for at in range(0, len(texts), 3000):
        some = texts[at : at + 3000]
        ids, offsets = own.encode_column(pa.array(some, pa.string()))
        expected = [lib.encode(t or "", add_special_tokens=False).ids for t in some]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == expected


def test_tasks_leave_no_chunks_in_their_worker(spark):
    """A worker that has packed documents serves other stages, with what it has learned no more in its memory."""
    docs = spark.createDataFrame([(i, "s", f"word{i} more{i} of{i}") for i in range(200)], "doc_id long, source string, text string").coalesce(1)
    path = public_tokenizers.path(FILE)
    packing.tokenised(docs, path, END_ID).collect()

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(bpe.load(path).index) - len(bpe.load(path).special)]})

    assert max(r.n for r in spark.range(8, numPartitions=4).mapInArrow(held, "n long").collect()) <= 1
