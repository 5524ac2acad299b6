"""Windows of benchmark items inside documents: a prefix-filtered set join with exact verification. DataFrame functions only.

Words are lower-cased (A to Z) runs of ASCII letters, digits and of all
characters beyond ASCII. An item's windows are its stretches of `window`
words; an item of fewer, but not none, is one window. A window's shingles are
its stretches of `shingle` words (all its words, if it has fewer).

A window occurs only where all its shingles do, so the one that is rarest in
the documents is a necessary prefix, and a window with a shingle that no
document has is out. Shingles of documents meet those of windows by hash; the
places of the rarest ones, which give where the window would start, are
candidates if the window fits into the document there (length and positional
bounds), and are verified word by word.

At scale: one pass over the documents hashes their shingles; those of windows
are broadcast up to `BROADCAST_ROWS`, beyond that the documents' shingles are
shuffled by hash to them. Only matching shingles are written, with one row of
counts per document. Candidates are gathered per document, as many as its own
words give, and meet its text in a second pass. Counts are pre-aggregated.

Odd input: documents without text or words have no hits; items without text or
words have no windows; rows without an id take part (items without an id are
not named); an item that occurs in several rows has the windows of all;
repeated documents each get a row. Columns beside id and text are ignored. Empty
tables give no rows, or no hits.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import small_enough, written

#: Rows of shingles, or of candidates, that are broadcast.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ROW = ["key", "key2"]


def words(text: Column) -> Column:
    given = F.coalesce(text, F.lit(""))
    # `lower` is much faster than `translate`, but also changes letters beyond ASCII.
    small = F.when(F.octet_length(given) == F.char_length(given), F.lower(given)).otherwise(F.translate(given, _UPPER, _LOWER))
    return F.array_remove(F.split(small, _GAP), "")


def windows(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(win, of_win, size) of all distinct windows, and (win, item): which items have them."""
    given = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter("size(w) > 0").withColumn("size", F.least(F.size("w"), F.lit(window)))
    each = given.select("item", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size))")).alias("of_win")).distinct()
    once = each.select("of_win").distinct().select(F.monotonically_increasing_id().alias("win"), "of_win", F.size("of_win").alias("size"))
    once = written(once, "decontaminate-windows")
    return once, each.join(once.select("win", "of_win"), "of_win").select("win", "item")


def _hashes(array: str, k: int) -> str:
    """Hashes of all stretches of k words; k is part of them."""
    return f"if(size({array}) < {k}, cast(array() as array<bigint>), transform(sequence(0, size({array}) - {k}), i -> xxhash64({k}, {', '.join(f'{array}[i + {j}]' for j in range(k))})))"


def _parts(found: DataFrame, shingle: int) -> DataFrame:
    """(win, size, k, at, h): the shingles of each window."""
    each = [found.filter((F.least("size", F.lit(shingle)) == k)).select("win", "size", F.lit(k).alias("k"), F.posexplode(F.expr(_hashes("of_win", k))).alias("at", "h")) for k in range(1, shingle + 1)]
    return written(functools.reduce(DataFrame.unionByName, each), "decontaminate-shingles")


def _with_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, key, key2): two hashes stand for a row; equal rows share them, and have the same result."""
    seen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return seen.select("*", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("key2"))


def matches(seen: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, key2, n) of all documents, and (key, key2, n, pos, h): places of the shingles that windows have."""
    tokens = parts.select("h", "k").distinct()
    sizes = sorted(r.k for r in parts.select("k").distinct().collect())  # not more than a shingle has words
    named = seen.select("doc_id", *_ROW, words(F.col("text")).alias("w")).withColumn("n", F.size("w").cast("long"))
    # All hashes of a document in one array, by size; a place in it tells the position once the size is known.
    hashes = F.concat(*[F.expr(_hashes("w", k)) for k in sizes]) if sizes else F.array().cast("array<bigint>")
    before = F.lit(0).cast("long")
    start = F.lit(0).cast("long")
    for k in sizes:
        start = F.when(F.col("k") == k, before).otherwise(start)
        before = before + F.greatest(F.col("n") - (k - 1), F.lit(0))
    place = (F.col("place") - start).alias("pos")
    if small_enough(parts, BROADCAST_ROWS):
        each = named.select("doc_id", *_ROW, "n", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), hashes)).alias("place", "h"))
        met = each.withColumn("place", F.col("place") - 1).join(F.broadcast(tokens), "h", "left").filter("place < 0 or k is not null")
        both = written(met.select("doc_id", *_ROW, "n", F.when(F.col("place") >= 0, F.col("place") - start).alias("pos"), "h"), "decontaminate-met")
        return both.filter("pos is null").select("doc_id", *_ROW, "n"), both.filter("pos is not null").drop("doc_id")
    rows = written(named.select("doc_id", *_ROW, "n"), "decontaminate-rows")
    each = named.select(*_ROW, "n", F.posexplode(hashes).alias("place", "h"))
    return rows, written(each.join(tokens, "h").select(*_ROW, "n", place, "h"), "decontaminate-met")


def occurrences(seen: DataFrame, met: DataFrame, parts: DataFrame, found: DataFrame) -> DataFrame:
    """(key, key2, win, start, size): where the windows occur in the documents, once for equal rows."""
    # The rarest shingle of each window; one that no document has comes first, and finds nothing.
    counts = met.groupBy("h").count()
    rarest = parts.join(counts, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "at", "h")).alias("r"))
    prefix = rarest.filter("r.n > 0").select("win", "r.at", "r.h").join(found, "win")
    prefix = F.broadcast(prefix) if small_enough(parts, BROADCAST_ROWS) else prefix
    start = F.col("pos") - F.col("at")
    candidates = met.join(prefix, "h").filter((start >= 0) & (start + F.col("size") <= F.col("n"))).select(*_ROW, start.cast("int").alias("start"), "win", "of_win").distinct()
    candidates = written(candidates, "decontaminate-candidates")
    gathered = candidates.groupBy(*_ROW).agg(F.collect_list(F.struct("start", "win", "of_win")).alias("all"))
    gathered = F.broadcast(gathered) if small_enough(candidates, BROADCAST_ROWS) else gathered
    texts = seen.select(*_ROW, "text").join(gathered, _ROW).select(*_ROW, "all", words(F.col("text")).alias("w"))
    fine = F.expr("filter(all, c -> slice(w, c.start + 1, size(c.of_win)) = c.of_win)")
    return texts.select(*_ROW, F.explode(fine).alias("c")).select(*_ROW, "c.win", "c.start", F.size("c.of_win").alias("size")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items) for each row of `docs`.

    `n_hit` counts the words inside any occurrence of a window, `items` are the
    ids, as sorted strings, of the items with a window that occurs.
    """
    found, owners = windows(items, window, item_id, item_text)
    parts = _parts(found, min(shingle, window))
    seen = _with_rows(docs, doc_id, text)
    rows, met = matches(seen, parts)
    places = written(occurrences(seen, met, parts, found), "decontaminate-places")
    hit = places.select(*_ROW, F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos")).distinct().groupBy(*_ROW).agg(F.count("*").alias("n_hit"))
    named = places.select(*_ROW, "win").distinct().join(owners, "win").groupBy(*_ROW).agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.join(hit, _ROW, "left").join(named, _ROW, "left")
    return out.select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
