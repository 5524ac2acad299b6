"""N-gram Jaccard join by filters under several global token orders.

A document's set holds the hashes (64 bits) of its distinct word shingles.
Documents with equal sets form a class, and classes are what is joined. Two
sets with Jaccard similarity of at least t share a token among the first
|x| - ceil(t |x|) + 1 tokens of each, whatever total order of tokens is used.
Here `ORDERS` orders are used, each by how common a token is (from counts over
all documents) and then by a hash of its own:

1. `common_tokens` counts tokens and keeps the common ones;
2. `keyed` writes for each document its class and its prefix under the first order;
3. candidates share a token of these prefixes, sizes that allow the
   similarity, and places of the token: what follows it in both sets must be
   enough for the intersection that the pair needs. (For the first token that
   two similar sets share, it is.) Their parities of token counts in `PARITIES`
   buckets differ at most as often as the pair's sets may differ in tokens, as
   each token that only one of them has turns one parity. All of this is part of
   the join's condition, so that a group of many copies that are just not
   similar enough makes no rows;
4. of what remains, `sketches` holds the prefixes under the other orders, and
   the numbers of tokens by bucket. A pair whose prefixes do not meet under
   every order, or whose smaller numbers by bucket do not add up to the
   intersection that it needs, can't be similar and goes;
5. only the rest is verified, on the whole sets, taken anew from the texts.

Groups of near copies would give a quadratic number of candidates. So first
each class is verified against one leader. A token's leader is the class that
has it earliest in its prefix, as the original has that copies with words of
their own stem from; a class takes the leader of most of its tokens. The links
found give components. Then candidates are formed again, only between classes of
different components, all of them. Where more than `LIST` classes share a token,
they meet by that token and a token of their prefixes under the second order,
which similar sets share as well; lists that are still longer are dealt out to
blocks, and each pair of blocks is a group of its own, so that no task gets a
long list whole. A pair that is in one component already
can't change the result; no other pair is left out.

Results, also for odd input:

* words are the runs of bytes other than ASCII white space, with A-Z in lower
  case; with fewer words than a shingle has, the whole sequence is one shingle;
* null, empty and blank texts have the empty set, link with nothing and are
  their own component;
* a component's id is its smallest doc_id; null doc_ids count only where there
  is no other, and such a component's id is null;
* repeated rows and equal texts are linked, each row gets a result row; a
  doc_id with several texts has a result row for each of them;
* texts of any length count whole; an empty table gives no rows;
* columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import in_small_batches, slices, small_enough, written
from queuelens.llm.components import components
from queuelens.llm.textstats import buffers, hashes, mix, spans

ORDERS = 3
#: A token met this often among so many tokens of a task is a common one's candidate.
SLICE_COUNT, SLICE_TOKENS = 2, 1_000_000
#: Buckets by whose parities candidates are compared; a multiple of 64.
PARITIES = 256
#: At most so many common tokens are told apart; it bounds what tasks receive.
COMMON_TOKENS = 200_000
#: Classes that meet in one group for one token.
LIST = 1024
#: Classes whose texts are fetched by a broadcast join; more by a shuffle.
BROADCAST_ROWS = 500_000

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_ODDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles in order, offsets of the texts in them)."""
    data, offsets = buffers(column)
    start, end, text = spans(~_WHITE[data], offsets)
    folded = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = hashes(folded, start, end)
    count = np.bincount(text, minlength=len(column))
    first = np.cumsum(count) - count
    many = np.where(count > 0, np.maximum(1, count - n + 1), 0)
    length = np.minimum(count, n)
    head = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    length = np.repeat(length, many)
    total = length.astype(np.uint64)
    for k in range(n):
        here = k < length
        total[here] = mix(total[here] * _ODDS[k % len(_ODDS)] + word[head[here] + k])
    return total, np.append(0, np.cumsum(many))


def common_tokens(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted common tokens, their classes from 1 to 63, rarer first)."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        keep = count >= SLICE_COUNT
        return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], names=["token", "count"])

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(shingles(part.column("text"), n)[0])
                if sum(map(len, held)) >= SLICE_TOKENS:
                    yield often(held)
                    held = []
        if held:
            yield often(held)

    counted = in_small_batches(docs.select("text")).mapInArrow(run, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    top = counted.orderBy(F.desc("count"), "token").limit(COMMON_TOKENS).toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    rank = np.clip(np.log2(np.maximum(top["count"].to_numpy(float), 1)) * 2, 1, 63).astype(np.uint64)
    return token[order], rank[order]


def _rarity(token: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(common[0]):
        return np.zeros(len(token), np.uint64)
    at = np.minimum(np.searchsorted(common[0], token), len(common[0]) - 1)
    return np.where(common[0][at] == token, common[1][at], np.uint64(0))


def _class(tokens: np.ndarray) -> bytes | None:
    """128-bit name of a set of sorted tokens; null for the empty one."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct tokens of each text."""
    token, offsets = shingles(column, n)
    return [np.unique(token[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def _prefixes(sets: list[np.ndarray], order: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The prefix of each set under one of the orders, in that order."""
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    own = flat if order == 0 else mix(flat ^ _ODDS[order])
    key = _rarity(flat, common) << np.uint64(58) | own >> np.uint64(6)
    out, at = [], 0
    for s in sets:
        size = len(s)
        take = size - -(-num * size // den) + 1 if size else 0
        own_key = key[at : at + size]
        first = np.argpartition(own_key, take - 1)[:take] if take < size else np.arange(size)
        out.append(s[first[np.argsort(own_key[first], kind="stable")]])
        at += size
    return out


def _parities(tokens: np.ndarray) -> np.ndarray:
    """Parities of the numbers of tokens by bucket, 64 to a word."""
    bucket = (mix(tokens ^ _ODDS[4]) % np.uint64(PARITIES)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)


def keyed(docs: DataFrame, n: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per document: doc_id, size of its set, its class (null if empty), its parities, its first prefix."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part.column("text"), n)
                first = _prefixes(sets, 0, num, den, common)
                values = pa.array(np.concatenate([*first, np.zeros(0, np.uint64)]).view(np.int64))
                prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(f) for f in first])), pa.int32()), values)
                parities = pa.array([_parities(s) for s in sets], pa.list_(pa.int64()))
                columns = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(map(_class, sets), pa.binary()), parities, prefix]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "cls", "parities", "prefix"])

    return in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, size int, cls binary, parities array<long>, prefix array<long>")


def _buckets(tokens: np.ndarray) -> bytes:
    """Numbers of tokens by bucket; empty where one of them does not fit a byte."""
    count = np.bincount((tokens & np.uint64((1 << max(6, len(tokens).bit_length() - 1)) - 1)).astype(np.int64), minlength=1 << max(6, len(tokens).bit_length() - 1))
    return count.astype(np.uint8).tobytes() if count.max() < 256 else b""


def _sizes_meet(a: dict, b: dict, num: int, den: int) -> bool:
    """Whether the smaller numbers by bucket add up to the intersection that the pair needs."""
    need = -(-num * (a["size"] + b["size"]) // (num + den))
    x, y = np.frombuffer(a["buckets"], np.uint8), np.frombuffer(b["buckets"], np.uint8)
    if not len(x) or not len(y):
        return True
    short = min(len(x), len(y))  # a bucket of the shorter one is several of the longer
    x, y = (z.reshape(-1, short).sum(axis=0, dtype=np.int64) for z in (x, y))
    return bool(np.minimum(x, y).sum() >= need)


def _orders_meet(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the prefixes share a token under every order."""
    return all(len(np.intersect1d(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32))) for p, q in zip(a, b))


def _fetch(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of one document for each class id in `wanted`."""
    ids = written(classes.join(wanted, "id", "left_semi").select(F.col("doc_id").alias("wanted")).distinct(), "jaccard-wanted")
    if small_enough(ids, BROADCAST_ROWS):
        ids = F.broadcast(ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")


def sketches(texts: DataFrame, n: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(cls, size, buckets, orders) of texts: numbers of tokens by bucket, and the prefixes under all orders but the first (32 bits of each token)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part.column("text"), n)
                orders = zip(*[_prefixes(sets, k, num, den, common) for k in range(1, ORDERS)])
                prefixes = [[(p >> np.uint64(32)).astype(np.uint32).tobytes() for p in o] for o in orders]
                columns = [pa.array(map(_class, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(map(_buckets, sets), pa.binary()), pa.array(prefixes, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "size", "buckets", "orders"])

    return in_small_batches(texts).mapInArrow(run, "cls binary, size int, buckets binary, orders array<binary>").filter(F.col("cls").isNotNull())


def token_sets(texts: DataFrame, n: int) -> DataFrame:
    """(cls, tokens) of texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part.column("text"), n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(s) for s in sets])), pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(map(_class, sets), pa.binary()), lists], names=["cls", "tokens"])

    return in_small_batches(texts).mapInArrow(run, "cls binary, tokens array<long>").filter(F.col("cls").isNotNull())


def _passing(met: DataFrame, test) -> DataFrame:
    """(u, v) of the rows (u, v, x, y) whose x and y pass a test."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keep = [test(a, b) for a, b in zip(part.column("x").to_pylist(), part.column("y").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return in_small_batches(met.select("u", "v", "x", "y")).mapInArrow(run, "u long, v long")


def filtered(pairs: DataFrame, sketch: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) of class ids whose sketches (id, size, buckets, orders) let them pass.

    The numbers by bucket come first, as they are short; prefixes are joined
    to what is left.
    """
    counts = sketch.select("id", F.struct("size", "buckets").alias("sketch"))
    met = pairs.join(counts.toDF("u", "x"), "u").join(counts.toDF("v", "y"), "v")
    pairs = written(_passing(met, lambda a, b: _sizes_meet(a, b, num, den)), "jaccard-bounded")
    orders = sketch.select("id", "orders")
    return _passing(pairs.join(orders.toDF("u", "x"), "u").join(orders.toDF("v", "y"), "v"), _orders_meet)


def _places_allow(left: str, right: str, size: str, other: str, num: int, den: int):
    """Whether the shorter rest, from the shared token on, can hold the intersection."""
    return F.least(F.col(left), F.col(right)) * (num + den) >= (F.col(size) + F.col(other)) * num


def _parities_allow(left: str, right: str, size: str, other: str, num: int, den: int):
    """Whether the sets may differ in as many tokens as there are different parities."""
    differ = sum((F.bit_count(F.col(left)[k].bitwiseXOR(F.col(right)[k])) for k in range(PARITIES // 64)), F.lit(0))
    return differ * (num + den) <= (F.col(size) + F.col(other)) * (den - num)


def second_prefixes(sketch: DataFrame) -> DataFrame:
    """(id, second): the tokens (32 bits) of each class's prefix under the second order."""

    def run(batches):
        for batch in batches:
            raw = batch.column("prefix").to_pylist()
            token = np.frombuffer(b"".join(raw), np.uint32).view(np.int32)
            ids = np.repeat(batch.column("id").to_numpy(), [len(x) // 4 for x in raw])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(token)], names=["id", "second"])

    return in_small_batches(sketch.select("id", F.col("orders")[0].alias("prefix"))).mapInArrow(run, "id long, second int")


def meeting(placed: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Pairs (u, v) of rows (keys, id, size, rest, root, parities) with equal keys and different roots that may be similar.

    Lists of equal keys are dealt out to blocks of about `LIST` rows; a row of
    one block meets a row of another in one place.
    """
    blocks = placed.groupBy(*keys).agg(F.ceil(F.count("*") / LIST).cast("int").alias("blocks"))
    dealt = placed.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = ["id", "size", "rest", "root", "parities"]
    left = dealt.select(*keys, F.col("block").alias("_row"), every.alias("_column"), *own)
    right = dealt.select(*keys, every.alias("_row"), F.col("block").alias("_column"), *[F.col(c).alias(f"v_{c}") for c in own])
    fits = _sizes_allow("size", "v_size", num, den) & _places_allow("rest", "v_rest", "size", "v_size", num, den)
    fits &= _parities_allow("parities", "v_parities", "size", "v_size", num, den)
    met = left.join(right, [*keys, "_row", "_column"]).filter((F.col("root") < F.col("v_root")) & fits)
    return met.select(F.col("id").alias("u"), F.col("v_id").alias("v"))


def _several_roots(placed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are shared by rows of another root."""
    mixed = placed.groupBy(*keys).agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select(*keys)
    return placed.join(mixed, keys, "left_semi")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of class ids that are similar enough, by their whole sets."""
    wanted = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    sets = token_sets(_fetch(docs, classes, wanted), n).dropDuplicates(["cls"]).join(classes.select("cls", "id"), "cls").select("id", "tokens")
    sets = written(sets, "jaccard-sets")
    full = pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
    same = F.size(F.array_intersect("x", "y"))
    return full.filter(same * den >= (F.size("x") + F.size("y") - same) * num).select("u", "v")


def _sizes_allow(a: str, b: str, num: int, den: int):
    return F.least(a, b) * den >= F.greatest(a, b) * num


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document.

    Documents link when den * |intersection| >= num * |union|. See the
    module's docstring.
    """
    common = common_tokens(docs, n)
    keys = written(keyed(docs, n, num, den, common), "jaccard-keys")
    # One document, the one with the least doc_id, stands for a class.
    own = F.min_by(F.struct("size", "parities", "prefix"), F.coalesce("doc_id", F.lit(2**63 - 1))).alias("own")
    classes = keys.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("doc_id"), own)
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "cls", "doc_id", "own.*"), "jaccard-classes")
    # Tokens that several classes have in their prefixes, and each list's leader.
    # `rest` counts the set's tokens from this one on.
    lists = classes.select(F.posexplode("prefix").alias("pos", "token"), "id", "size").select("token", "id", "size", "pos", (F.col("size") - F.col("pos")).alias("rest"))
    shared = lists.groupBy("token").agg(F.count("*").alias("members"), F.min(F.struct("pos", "id", "size", "rest")).alias("lead")).filter("members > 1").select("token", "lead")
    lists = written(lists.drop("pos").join(shared, "token"), "jaccard-postings")
    # First: each class against the leader it shares most prefix tokens with.
    fits = _sizes_allow("size", "lead.size", num, den) & _places_allow("rest", "lead.rest", "size", "lead.size", num, den)
    led = lists.filter((F.col("id") != F.col("lead.id")) & fits).groupBy("id", F.col("lead.id").alias("lead")).agg(F.count("*").alias("tokens"))
    led = led.groupBy(F.col("id").alias("u")).agg(F.max(F.struct("tokens", F.col("lead").alias("v"))).alias("best")).select("u", "best.v")
    led = written(led, "jaccard-led")
    texts = _fetch(docs, classes, lists.select("id").distinct())
    sketch = sketches(texts, n, num, den, common).dropDuplicates(["cls"]).join(classes.select("cls", "id"), "cls").select("id", "size", "buckets", "orders")
    sketch = written(sketch, "jaccard-sketches")
    led = written(filtered(led, sketch, num, den), "jaccard-candidates")
    found = written(verified(led, classes, docs, n, num, den), "jaccard-links")
    roots = written(components(found), "jaccard-roots")
    # Then: all candidates between different components.
    placed = lists.join(roots.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "size", "rest", F.coalesce("root", "id").alias("root"))
    placed = _several_roots(placed, ["token"]).join(classes.select("id", "parities"), "id")
    placed = written(placed.select("token", "id", "size", "rest", "root", "parities"), "jaccard-mixed")
    long = placed.groupBy("token").count().filter(F.col("count") > LIST).select("token")
    long = written(placed.join(long, "token", "left_semi"), "jaccard-long")
    if long.limit(1).count():
        pairs = meeting(placed.join(long.select("token").distinct(), "token", "left_anti"), ["token"], num, den)
        # Tokens of one component alone meet nobody; what is left is joined once, not for each reader.
        ids = long.select("id", "root").distinct()
        second = second_prefixes(sketch.join(ids, "id", "left_semi")).join(ids, "id")
        second = written(_several_roots(second, ["second"]).select("id", "second"), "jaccard-second")
        both = written(long.join(second, "id"), "jaccard-both")
        both = written(_several_roots(both, ["token", "second"]), "jaccard-both")
        pairs = pairs.unionByName(meeting(both, ["token", "second"], num, den)).distinct()
    else:
        pairs = meeting(placed, ["token"], num, den).distinct()
    pairs = written(filtered(pairs, sketch, num, den), "jaccard-candidates")
    found = found.unionByName(verified(pairs, classes, docs, n, num, den))
    roots = components(found).withColumnRenamed("node", "id")
    named = written(classes.select("cls", "doc_id", "id").join(roots, "id", "left").select("cls", "doc_id", F.coalesce("root", "id").alias("root")), "jaccard-named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("cls", "component_id")
    result = keys.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "cls").join(named, "cls", "left")
    return result.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
