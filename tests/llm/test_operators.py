"""Operators against libraries and brute force."""

from __future__ import annotations

import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from queuelens.llm import bpe, html, jaccard, nndescent, op3_packing, op5_pii, packing, pii, quality, quotes, textstats, topk
from queuelens.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = ["", "aaaa aaaaaaa", "ΣΑΣ ΟΔΟΣ", "x<|endoftext|>y <|startoftext|>", "̀á", "it's DON'T we'll", "数字１２３ ४५", "a​b\x00c", "🙂🙂 👩‍👩‍👧", " \t\n\r\x0b\x1c\x85　x", "a  b   c \n d\n\n\n e\t\tf  ", "\x1ca\x1f b", "½²Ⅷ", "_a_b__ --== ..."]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_tokenizers(spark, file):
    texts = ODD + [r.text for r in table(spark, SF, "documents").collect()]
    lib, own = Tokenizer.from_file(P.path(file)), bpe.Bpe(P.path(file))
    expected = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    ids, offsets = own.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == expected
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
    assert own.decode_lists(lists).to_pylist() == [lib.decode(e, skip_special_tokens=False) for e in expected]


def test_quality_held_out_accuracy():
    import pyarrow.dataset as ds

    docs, labels = (ds.dataset(f"/root/testdata/sf0.01/{t}.parquet").to_table().to_pandas() for t in ("documents", "labels"))
    both = docs.merge(labels, on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id])
    x, y = quality.features(pa.array(both.text, pa.string())), both.quality.to_numpy(float)
    model = quality.fit(x[~held], y[~held])
    assert ((model.score(x[held]) >= 0.3) == y[held]).mean() > 0.95


def test_features_do_not_depend_on_neighbours():
    texts = ["Some text, here.", "", "más | más | más\nA A", "zz"]
    together = quality.features(pa.array(texts))
    alone = np.vstack([quality.features(pa.array([t])) for t in texts])
    assert np.allclose(together, alone)


def test_hashes_are_of_content_alone():
    data, offsets = textstats.buffers(pa.array(["ab cd", "xx cd ab"]))
    start, end, _ = textstats.spans(data != 32, offsets)
    h = textstats.hashes(data, start, end)
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_packing_covers_every_token_once(spark):
    docs = table(spark, SF, "documents")
    got = op3_packing.pieces(docs).toPandas()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*lib.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for key, at in (("doc_id", "start"), ("sequence_id", "offset")):
        for _, g in got.sort_values(at).groupby(key):
            assert (g[at].to_numpy() == np.append(0, np.cumsum(g.length))[:-1]).all()
    assert got.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    full = got.groupby("sequence_id").length.sum()
    assert (full.drop(full.index.max()) == 2048).all()


@pytest.mark.parametrize("targets", [None, [0.5, 0.3, 0.2], [1.0, 0.0, 0.0]])
def test_schedule_equals_deficit_round_robin(targets):
    """The closed form sends what a loop over rounds and queues sends."""
    totals = np.array([40_000, 9_000, 123_457])
    wanted = totals.astype(float) if targets is None else np.array(targets)
    s = packing.Schedule(totals, wanted, 256, 2048)
    chunks, sent, credit, order = -(-totals // 256), np.zeros(3, int), np.zeros(3, np.int64), []
    while (chunks - sent).any():
        left = chunks - sent
        share = np.where(left > 0, wanted, 0.0)
        share = share if share.sum() else left.astype(float)
        quantum = np.where(left > 0, np.maximum(1, np.round(share / share.sum() * 8 * (1 << packing.BITS))), 0).astype(np.int64)
        while True:
            credit += quantum
            for q in range(3):
                while sent[q] < chunks[q] and credit[q] >= 1 << packing.BITS:
                    credit[q] -= 1 << packing.BITS
                    order.append((q, sent[q]))
                    sent[q] += 1
            if (sent[quantum > 0] == chunks[quantum > 0]).any():
                break
        credit[sent == chunks] = 0
    queue, chunk = (np.array(c, np.int64) for c in zip(*order))
    assert (s.slots(queue, chunk) == np.arange(len(order))).all()


def test_sequences_hold_the_target_shares():
    totals = np.array([3_000_000, 1_000_000, 500_000])
    s = packing.Tree(totals, totals.astype(float), 256, 2048)
    doc, _, length, seq, _ = s.pieces(np.arange(3), np.zeros(3, np.int64), totals)
    share = np.zeros((seq.max() + 1, 3))
    np.add.at(share, (seq, doc), length)
    upto = np.cumsum(share, axis=0)[:-1]
    wanted = np.arange(1, len(upto) + 1)[:, None] * 2048 * totals / totals.sum()
    assert np.abs(upto - wanted).max() < 3 * 256 + 2048


def brute_spans(text):
    found = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(pii.BASE[k], text) if pii.valid(k, m[0])]
    return pii.ordered(found)


def test_pii_base_equals_patterns(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab.1@+- ()9") for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += [r.text for r in table(spark, SF, "documents").collect()]
    assert all(pii.plain_spans(t) == brute_spans(t) for t in texts)


DISGUISED = {
    "write to john dot smith at example dot com now": [("email", "john dot smith at example dot com")],
    "john [at] example [dot] org": [("email", "john [at] example [dot] org")],
    "call plus four four two zero seven nine four six zero nine five eight ok": [("phone", "plus four four two zero seven nine four six zero nine five eight")],
    "＋１ (555) 123-4567 x": [("phone", "＋１ (555) 123-4567")],
    "jоhn@exаmple.com hi": [("email", "jоhn@exаmple.com")],
    "4111​1111 1111​1111": [("card", "4111​1111 1111​1111")],
    "ip 10 dot 0 dot 0 dot 1 fine": [("ip", "10 dot 0 dot 0 dot 1")],
    "look at it. The dot com boom": [],
    "un deux trois, one at a time; see me at home.com": [],
}


def test_pii_deobfuscation(spark):
    df = spark.createDataFrame(list(enumerate(DISGUISED)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [(s.kind, r.text[s.start : s.end]) for s in r.pii] == DISGUISED[r.text]
    assert "john" not in pii.find(df).filter("doc_id = 1").first().redacted


SPELLED = {
    "at one nine two dot one six eight dot zero dot one ok": [("ip", "one nine two dot one six eight dot zero dot one")],
    "host one nine two point 168 point zero point double one": [("ip", "one nine two point 168 point zero point double one")],
    "call +44 20 seven nine four six 0958 now": [("phone", "+44 20 seven nine four six 0958")],
    "plus triple five double one double two three four.": [("phone", "plus triple five double one double two three four")],
    "pay 4111 one one one one 1111 double 1 11 please": [("card", "4111 one one one one 1111 double 1 11")],
    "one, two, three dot four; point two five": [],
    "en 1999 un 2 dos, nine one dot five": [],
}


def test_spelled_identifiers_of_few_words(spark):
    df = spark.createDataFrame(list(enumerate(SPELLED)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [(s.kind, r.text[s.start : s.end]) for s in r.pii] == SPELLED[r.text]


def test_op5_columns(spark):
    got = op5_pii.op5_pii(spark, SF)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert got.agg(F.sum(F.col("n_email") + F.col("n_phone"))).first()[0] > 0


def brute_components(texts, n, num, den):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        same = len(sets[a] & sets[b])
        if same and den * same >= num * (len(sets[a]) + len(sets[b]) - same):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, n, num):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            own = [rng.choice(words) if rng.random() < 0.01 else w for w in base]
            texts.append(" ".join(own + ["shared passage of many words"] * rng.randint(0, 2)))
    texts += ["same " * 50, "same " * 60, "Same " * 50, "a b", "A b", None, ""]
    expected, sizes = brute_components(texts, n, num, 100)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in jaccard.join(df, n, num, 100).collect()}
    assert [got[i].component_id for i in range(len(texts))] == expected
    assert [got[i].n_shingles for i in range(len(texts))] == sizes


def test_jaccard_filters_never_lose_a_similar_pair():
    rng = np.random.default_rng(2)
    for _ in range(300):
        base = rng.integers(0, 2**63, rng.integers(5, 400)).astype(np.uint64)
        x = np.unique(base)
        y = np.unique(np.append(base[rng.random(len(base)) > 0.08], rng.integers(0, 2**63, 2).astype(np.uint64)))
        both = len(np.intersect1d(x, y))
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        sketch = lambda s: {"size": len(s), "buckets": jaccard._buckets(s), "orders": [(jaccard._prefixes([s], k, 80, 100, none)[0] >> np.uint64(32)).astype(np.uint32).tobytes() for k in (1, 2)]}
        if 100 * both >= 80 * (len(x) + len(y) - both):
            a, b = sketch(x), sketch(y)
            assert jaccard._sizes_meet(a, b, 80, 100) and jaccard._orders_meet(a["orders"], b["orders"])
            differ = sum(int(p ^ q).bit_count() for p, q in zip(jaccard._parities(x).view(np.uint64), jaccard._parities(y).view(np.uint64)))
            assert differ <= len(x) + len(y) - 2 * both


def test_quotes_link_levels_and_branches(spark):
    rows = [
        (1, 0, "user", "Where is it?\nI looked."), (1, 1, "a", "> Where  is it?\n\nOver there."), (1, 2, "b", "> Where is it?\nNo idea."),
        (1, 3, "user", "> > Where is it?\n> Over there.\nThanks."), (1, 4, "a", "Welcome."), (2, 0, "x", "> Thanks.\nFor what?"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1].text == "Over there." and got[1, 1].reply_to == 0 and got[1, 2].reply_to == 0
    assert got[1, 3].reply_to == 1 and got[1, 3].n_quotes == 2 and got[1, 3].n_linked == 2
    assert [got[1, t].branch for t in range(5)] == [0, 0, 2, 0, 0] and [got[1, t].depth for t in range(5)] == [0, 1, 1, 2, 3]
    assert got[2, 0].n_linked == 1 and got[2, 0].reply_to is None


@pytest.mark.parametrize("block", [2048, 3])
def test_topk_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((400, 6)), 1)
    x[50:90] = x[50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = [(r.query_id, r["rank"], r.id, r.score) for r in topk.search(df, "id % 50 = 0", 5).orderBy("query_id", "rank").collect()]
    v = np.floor(x * 256).astype(np.int64)
    expected = []
    for q in range(0, 400, 50):
        best = sorted((-int(v[q] @ v[c]), c) for c in range(400) if c != q)[:5]
        expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == expected


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 32)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 24))
    x[100:220] = x[100] + 0.12 * rng.standard_normal((120, 24))  # more than a list holds
    for i in range(300, 400, 2):
        x[i + 1] = x[i] + 0.1 * rng.standard_normal(24)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.id: r for r in nndescent.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(500))
    assert all(got[i].n_links <= near[i].sum() for i in range(500)) and found >= 0.97 * near.sum()
    assert got[101].component_id == 100 and not got[101].kept and got[100].kept


def groups_of(rng, groups, size, dim=64):
    """Tight groups near each other: cosine about 0.99 inside a group, 0.92 between groups."""
    axes = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    noise = rng.standard_normal((groups * size, dim))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return np.sqrt(0.92) * axes[0] + np.sqrt(0.07) * axes[1 + np.arange(groups * size) // size] + 0.1 * noise


def brute_links(x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while (low := np.minimum(root, np.where(near, root, len(x)).min(axis=1))).tolist() != root.tolist():
        root = low
    return near.sum(axis=1).tolist(), root.tolist()


def found_links(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = sorted(nndescent.near_duplicates(df).collect())
    return [r.n_links for r in got], [r.component_id for r in got]


def test_links_between_saturated_groups(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 64)
    rng = np.random.default_rng(5)
    x = np.vstack([groups_of(rng, 8, 30), rng.standard_normal((100, 64))])
    assert found_links(spark, x) == brute_links(x)


def test_links_are_whole_when_every_audit_fails(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "audit", lambda *_: 0.0)
    monkeypatch.setattr(nndescent, "MAX_ROUNDS", 1)
    rng = np.random.default_rng(6)
    x = np.vstack([groups_of(rng, 1, 150), rng.standard_normal((50, 64))])
    assert found_links(spark, x) == brute_links(x)


def test_tables_grow_with_bits():
    side = 1 - np.arccos(0.9) / np.pi
    assert all(1 - (1 - side**bits) ** nndescent.tables_for(bits, 0.9) >= 0.99 for bits in range(1, 20))


def test_audit_sees_few_links_and_knows_when_it_saw_none(spark, monkeypatch):
    x = np.random.default_rng(8).standard_normal((2000, 32))
    x[1] = x[0] + 0.01
    nodes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "node long, v array<double>, many long")
    none = spark.createDataFrame([], "node long, n long"), spark.createDataFrame([], "node long, root long")
    assert nndescent.audit(nodes, *none, 32, 0.9) == 0
    monkeypatch.setattr(nndescent, "AUDIT_NODES", 256)
    monkeypatch.setattr(nndescent, "AUDIT_PAIRS", 1)
    assert nndescent.audit(nodes.filter("node > 0"), *none, 32, 0.9) is None


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><div class="site-menu"><a href="/">Home</a></div><header><p>Daily, news, here.</p></header><div id="cookie-notice"><p>We use cookies, really.</p></div><main><article><h1>Title</h1><p>Real&nbsp;text, with <b>bold</b> and <a href="x">a link</a>.<br>Next &lt;line&gt;<p>Second paragraph</p><form><label>Mail</label></form><ul><li>item one</li></ul><section class="comments"><p>First! Nice, text.</p></section></article></main><aside><p>See also, this.</p></aside><footer>(c) me, you.</footer></body>'


def test_html_content():
    assert html.content(PAGE) == "Title Real text, with bold and a link. Next <line> Second paragraph item one"


def test_html_without_article():
    page = "<body><div><a href=1>One</a> <a href=2>Two</a></div><div><p>Long enough text, with marks, and more of it here.</p><p>And another one, as long as that, or longer.</p></div><div><span>x</span></div>"
    assert html.content(page) == "Long enough text, with marks, and more of it here. And another one, as long as that, or longer."


def test_html_keeps_a_post_beside_articles():
    post = "The post itself, with several sentences. It is long enough, and it has marks."
    page = f'<body><nav>Home</nav><div class="page"><div class="post"><h1>Head</h1><p>{post}</p></div><article class="comment"><p>First! A comment, not short either.</p></article></div>'
    assert html.content(page) == f"Head {post}"
    assert html.content(page.replace('"comment"', '"teaser"').replace("A comment, not short either.", "Short.")).startswith(f"Head {post}")
    assert html.content(f'<body><p>Some.</p><article class="post comments-open"><p>{post}</p></article>') == post


def test_html_keeps_lists_and_tables_between_paragraphs():
    long = "A paragraph of some length, with marks, and much more than that. " * 6
    page = f"<body><div><a href=1>Menu</a></div><div><p>{long}</p><ul><li>forty characters of an item of a list</li></ul><table><tr><td>cell</td></tr></table><p>{long}</p></div>"
    assert html.content(page) == f"{long.strip()} forty characters of an item of a list cell {long.strip()}"


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as C

    docs = table(spark, SF, "documents")
    good = C.keep_good(spark, docs, SF)
    bad = {r.doc_id for r in table(spark, SF, "labels").filter("quality = 0").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and len(bad & kept) <= 0.2 * len(bad) + 1
    one = C.keep_one(spark, good, SF)
    expected, _ = brute_components([r.text for r in good.orderBy("doc_id").collect()], 5, 80, 100)
    ids = sorted(kept)
    assert sorted(r.doc_id for r in one.collect()) == sorted({ids[i] for i in expected})
    clean = C.redact(spark, one, SF)
    assert clean.columns == docs.columns and clean.filter("text rlike '[a-z0-9]@[a-z0-9]+[.]'").count() == 0
    packed = C.sequences(spark, clean, SF)
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_pipeline_with_repeated_and_null_ids(spark):
    import corpus_pipeline as C

    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (None, text), (2, None), (2, ""), (None, "other words than these are here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(1))
    assert C.keep_one(spark, df, SF).count() == 4 and C.keep_one(spark, df.limit(0), SF).count() == 0
