"""Phrases of words that occur together more often than apart, by language: hierarchical pair naming.

Texts are lower-cased (A to Z) and cut at marks of punctuation and line ends
into pieces, these at spaces and tabs into words. Words that occur `least`
times in a language get a number. A phrase of k words is a pair of overlapping
phrases of k - 1 words, one word apart: where both are frequent, their
numbers are replaced by that of the pair, if it is frequent itself. Numbers are
given to pairs over the whole table. A pair's two parts are its parents: they
lead to the counts of all first and last parts, for the cuts, and from a
longer phrase to those that it contains.

A phrase's score is the least, over its cuts in two, of a * n / (l * r): its
count times the number of words, by the product of the parts' counts, in
thousandths and rounded down; the arithmetic is exact, in decimals of 38
digits. A phrase that occurs as often inside one longer phrase as at all is
dropped. (A longer phrase is not more frequent than what it contains, so only
the next longer ones are asked.)

At scale: tasks count in numpy; only pairs of frequent parents are counted, and
travel in packed rows by bucket to where their counts are added up, a bucket at
a time; there are as many buckets as bound their size. The numbers are broadcast to the tasks up to `NAMES` of a
level; beyond that the places of the words are rows and meet the numbers by
joins. Rankings first keep the best of `SALTS` parts of a language.

Odd input: null texts are empty, a null language is `und`; repeated rows count
as often as they occur; texts without words give none; other columns are
ignored. An empty table gives no rows. Ties in the score go to the more
frequent phrase, then to the smaller one in the order of UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queuelens.llm.common import in_small_batches, slices, written
from queuelens.llm.textstats import buffers, equal_words, hashes, mix, spans

#: Numbers of a level that are broadcast.
NAMES = 2_000_000
#: Text that a task handles at a time, in bytes.
SLICE = 4 << 20
SALTS = 64
#: Words of the table for each bucket of pairs, so that what a task merges at once is bounded; and buckets at least.
BUCKET, LEAST_BUCKETS = 1 << 22, 1024
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False

Flat = tuple[np.ndarray, np.ndarray, np.ndarray]


def _words(batch: pa.RecordBatch):
    """(bytes, start, end, row, place) of all words of a batch (lang, text); words that follow each other in a piece have places that do."""
    data, offsets = buffers(batch.column(1))
    data = _LOWER[data]
    start, end, row = spans(_WORD[data], offsets)
    before = np.append(0, np.cumsum(_BREAK[data]))
    return data, start, end, row, np.arange(len(start)) + before[start] + row


def _key(data: np.ndarray, start: np.ndarray, end: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return hashes(data, start, end) ^ mix(lang.astype(np.uint64) + np.uint64(1))


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.append(0, np.cumsum(size))
    flat = np.arange(int(offsets[-1])) + np.repeat(start - offsets[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[flat]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if "text" in batch.schema.names:
            yield from slices(batch, "text", SLICE)
        else:
            yield batch


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        data, start, end, row, _ = _words(batch)
        langs, of_row = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        lang = of_row[row]
        _, first, group, count = np.unique(_key(data, start, end, lang), return_index=True, return_inverse=True, return_counts=True)
        to = first[group]
        if not ((lang == lang[to]).all() and equal_words(data, start, end, data, start[to], end[to]).all()):
            first, count = np.arange(len(start)), np.ones(len(start), np.int64)  # two words share a key
        totals = np.bincount(lang, minlength=len(langs))
        word = pa.concat_arrays([_strings(data, start[first], end[first]), pa.nulls(len(langs), pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array(list(langs[lang[first]]) + list(langs), pa.string()), word, pa.array(np.append(count, totals), pa.int64())], names=["lang", "word", "n"])


@dataclass
class Places:
    """Where numbered phrases of one length stand.

    `read` gives (row, place, number) of a batch of `df`, in order; if it is
    None, `df` itself has these columns.
    """

    df: DataFrame
    read: Callable[[pa.RecordBatch], Flat] | None


def _follow(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are followed by one a word further on, and the pairs of their numbers."""
    row, place, number = flat
    at = np.flatnonzero((place[1:] == place[:-1] + 1) & (row[1:] == row[:-1]))
    return at, (number[at] << 32) | number[at + 1]


def _lists(batch: pa.RecordBatch) -> Flat:
    place, number = batch.column(0), batch.column(1)
    return np.repeat(np.arange(len(batch)), np.diff(place.offsets.to_numpy())), place.flatten().to_numpy().astype(np.int64), number.flatten().to_numpy().astype(np.int64)


def _packed(batches: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, keys, counts) of each (keys, counts): keys of a bucket travel together."""
    for key, count in batches:
        bucket = (mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[order], return_index=True)
        offsets = pa.array(np.append(first, len(order)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (key, count))], names=["bucket", "key", "n"])


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs that occur `least` times, from packed rows in the order of their buckets; one bucket is held at a time."""

    def flush(held):
        if not held:
            return
        key, count = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total, key = np.add.reduceat(count, first), key[first]
        key, total = key[total >= least], total[total >= least]
        yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(total)], names=["left", "right", "f"])

    held, now = [], None
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        keys, counts = (batch.column(i).flatten().to_numpy() for i in (1, 2))
        offsets = np.append(0, np.cumsum(batch.column(1).value_lengths().to_numpy()))
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            if bucket[i] != now:
                yield from flush(held)
                held, now = [], bucket[i]
            held.append((keys[offsets[i] : offsets[j]], counts[offsets[i] : offsets[j]]))
    yield from flush(held)


def pairs(places: Places, least: int, buckets: int) -> DataFrame:
    """(left, right, f): the pairs of numbered phrases that overlap but for a word `least` times."""
    if places.read is None:
        a, b = places.df.withColumnRenamed("number", "left"), places.df.select("row", (F.col("place") - 1).alias("place"), F.col("number").alias("right"))
        return a.join(b, ["row", "place"]).groupBy("left", "right").agg(F.count("*").alias("f")).filter(F.col("f") >= least)
    read = places.read
    counted = lambda batches: _packed((np.unique(_follow(read(batch))[1], return_counts=True) for batch in _parts(batches)), buckets)
    packed = in_small_batches(places.df).mapInArrow(counted, "bucket long, key array<long>, n array<long>")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _merged(batches, least), "left long, right long, f long")


def renamed(places: Places, names: DataFrame, small: bool) -> Places:
    """The places of the pairs that have a number in `names` (id, left, right)."""
    if places.read is not None and not small:
        places = _rows(places)
    if places.read is None:
        a, b = places.df.withColumnRenamed("number", "left"), places.df.select("row", (F.col("place") - 1).alias("place"), F.col("number").alias("right"))
        met = a.join(b, ["row", "place"]).join(names.select("left", "right", F.col("id").alias("number")), ["left", "right"]).select("row", "place", "number")
        return Places(written(met, "collocations-places"), None)
    given = names.select("left", "right", "id").toArrow()
    left, right, number = (given.column(i).to_numpy() for i in range(3))
    key = (left << 32) | right
    order = np.argsort(key)
    sent, read = names.sparkSession.sparkContext.broadcast((key[order], number[order])), places.read

    def run(batches):
        key, number = sent.value
        for batch in _parts(batches):
            flat = read(batch)
            at, pair = _follow(flat)
            to = np.minimum(np.searchsorted(key, pair), len(key) - 1)
            found = key[to] == pair
            row, place, new = flat[0][at][found], flat[1][at][found], number[to[found]]
            used, size = np.unique(row, return_counts=True)
            offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (place, new)]
            yield pa.RecordBatch.from_arrays(lists, names=["place", "number"])

    return Places(written(in_small_batches(places.df).mapInArrow(run, "place array<int>, number array<int>"), "collocations-places"), _lists)


def _rows(places: Places) -> Places:
    """The same with a row for each place."""
    read = places.read

    def run(batches):
        for batch in _parts(batches):
            row, place, number = read(batch)
            used, size = np.unique(row, return_counts=True)
            offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place, number)], names=["place", "number"])

    lists = in_small_batches(places.df).mapInArrow(run, "place array<long>, number array<long>").withColumn("row", F.monotonically_increasing_id())
    return Places(written(lists.select("row", F.explode(F.arrays_zip("place", "number")).alias("x")).select("row", "x.place", "x.number"), "collocations-places"), None)


def _word_rows(docs: DataFrame, names: DataFrame) -> Places:
    """The places of numbered words as rows, joined."""

    def run(batches):
        for batch in _parts(batches):
            data, start, end, row, place = _words(batch)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(batch)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(place)), pa.ListArray.from_arrays(offsets, _strings(data, start, end))], names=["lang", "place", "word"])

    lists = in_small_batches(docs).mapInArrow(run, "lang string, place array<long>, word array<string>").withColumn("row", F.monotonically_increasing_id())
    each = lists.select("row", "lang", F.explode(F.arrays_zip("place", "word")).alias("x")).select("row", "lang", "x.place", "x.word")
    met = each.join(names.select("lang", "word", F.col("id").alias("number")), ["lang", "word"]).select("row", "place", "number")
    return Places(written(met, "collocations-places"), None)


def word_places(docs: DataFrame, names: DataFrame, small: bool) -> Places:
    """The places of the words that have a number in `names` (id, lang, word)."""
    if not small:
        return _word_rows(docs, names)
    given = names.select("lang", "word", "id").toArrow().combine_chunks()
    known = {lang: i for i, lang in enumerate(sorted(set(given.column("lang").to_pylist())))}
    lang = np.array([known[x] for x in given.column("lang").to_pylist()], np.int64)
    data, offsets = buffers(pa.concat_arrays(given.column("word").chunks) if given.num_rows else pa.array([], pa.string()))
    key = _key(data, offsets[:-1], offsets[1:], lang)
    order = np.argsort(key)
    if (key[order][1:] == key[order][:-1]).any():
        return _word_rows(docs, names)  # two words share a key
    table = (key[order], lang[order], data, offsets[:-1][order], offsets[1:][order], given.column("id").to_numpy()[order], known)
    sent = names.sparkSession.sparkContext.broadcast(table)

    def read(batch: pa.RecordBatch) -> Flat:
        key, langs, there, first, last, number, known = sent.value
        data, start, end, row, place = _words(batch)
        lang = np.array([known.get(x, len(known)) for x in batch.column(0).to_pylist()], np.int64)[row]
        to = np.searchsorted(key, wanted := _key(data, start, end, lang))
        to = np.minimum(to, len(key) - 1)
        hit = np.flatnonzero((key[to] == wanted) & (langs[to] == lang)) if len(key) else np.zeros(0, np.int64)
        hit = hit[equal_words(data, start[hit], end[hit], there, first[to[hit]], last[to[hit]])]
        return row[hit], place[hit], number[to[hit]]

    return Places(docs, read)


def numbered(counts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """The rows of `counts` with f >= `least`, with dense ids from 0; and how many there are."""
    kept = counts.filter(F.col("f") >= least).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"))
    kept = written(kept, "collocations-names")
    sizes = sorted((r["part"], r["count"]) for r in kept.groupBy("part").count().collect())  # one row for each partition of the shuffle
    first, moves = 0, []
    for part, size in sizes:
        moves.append((part, first - (part << 33)))
        first += size
    offsets = kept.sparkSession.createDataFrame(moves, "part int, move long")
    return kept.join(F.broadcast(offsets), "part").withColumn("id", F.col("seq") + F.col("move")).drop("part", "seq", "move"), first


def levels(docs: DataFrame, least: int, longest: int, names_limit: int = NAMES) -> tuple[list[DataFrame], DataFrame]:
    """(id, left, right, lang, phrase, last, f, first_f, last_f) of the frequent phrases of each length from 1, and (lang, n).

    `first_f` and `last_f` are the counts of a phrase's shorter first and last parts, by their length.
    """
    counts = in_small_batches(docs).mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = written(counts.filter((F.col("f") >= least) | F.col("word").isNull()), "collocations-words")
    totals = counts.filter("word is null").select("lang", F.col("f").alias("n"))
    buckets = max(LEAST_BUCKETS, (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    names, many = numbered(counts.filter("word is not null"), least)
    none = F.array().cast("array<bigint>")
    found = [written(names.select("id", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("first_f"), none.alias("last_f")), "collocations-level")]
    places = word_places(docs, names, many <= names_limit) if many else None
    while many and len(found) < longest:
        names, many = numbered(pairs(places, least, buckets), least)
        a, b = found[-1].alias("a"), found[-1].alias("b")
        met = names.alias("x").join(a, F.col("x.left") == F.col("a.id")).join(b, F.col("x.right") == F.col("b.id"))
        level = met.select("x.id", "x.left", "x.right", "a.lang", F.concat_ws(" ", "a.phrase", "b.last").alias("phrase"), "b.last", "x.f", F.concat("a.first_f", F.array("a.f")).alias("first_f"), F.concat("b.last_f", F.array("b.f")).alias("last_f"))
        found.append(written(level, "collocations-level"))
        if many and len(found) < longest:
            places = renamed(places, names, many <= names_limit)
    return found, totals


def scored(found: list[DataFrame], totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two words and more that no longer one makes superfluous."""
    count = F.col("f")
    out = found[0].join(totals, "lang").limit(0).select("lang", "phrase", count.alias("a"), count.alias("l"), count.alias("r"), "n", count.alias("score"))
    for k, level in enumerate(found[1:], start=2):
        if k < len(found):
            above = found[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("within")).groupBy("id").agg(F.max("within").alias("within"))
            level = level.join(above, "id", "left").filter("within is null or 100 * within < 100 * f")
        seen = level.join(F.broadcast(totals), "lang")
        cuts = []
        for cut in range(1, k):
            l, r = F.col("first_f")[cut - 1], F.col("last_f")[k - cut - 1]  # noqa: E741
            score = F.expr(f"cast(1000 * cast(f as decimal(19,0)) as decimal(23,0)) * cast(n as decimal(15,0)) div (cast(first_f[{cut - 1}] as decimal(19,0)) * cast(last_f[{k - cut - 1}] as decimal(19,0)))")
            cuts.append(F.struct(score.alias("score"), F.lit(cut).alias("cut"), l.alias("l"), r.alias("r")))
        best = seen.withColumn("best", F.array_min(F.array(*cuts)))
        rows = best.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")
        out = rows if k == 2 else out.unionByName(rows)
    return out


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text: str = "text", lang: str = "lang", names_limit: int = NAMES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language."""
    if longest < 2:
        raise ValueError("phrases have at least two words")
    given = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found, totals = levels(given, least, longest, names_limit)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = scored(found, totals).withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
