"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size. For a block, every task scores
its candidates against all queries of the block. First only histograms leave
the tasks: counts by query and score bin, summed up over all tasks, show which
bin holds the query's k-th best score. That bin's range is divided into bins
again, until it is a single score. Then the candidates above the k-th score,
and of those at it the ones with the smallest ids, are ranked.

Scores are integer inner products; where one lies beyond 62 bits, the search
ends with an error instead of a wrong result.

Results, also for odd input:

* vectors that are null or hold null or non-finite components take no part,
  neither do rows without an id;
* a query's own row, and any row with its id, is no candidate; other repeated
  rows are candidates each;
* of several rows with a query's id, the least vector is the query;
* vectors shorter than the longest one are filled up with zeros;
* equal scores rank by the smaller id; with fewer than k candidates all rank;
* an empty table gives no rows; columns beside id and vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queuelens.llm.common import shared_dir, written
from queuelens.llm.vectors import matrix, usable

#: Queries that are scored together; it bounds what is sent to each task.
BLOCK = 2048
BINS = 1024
#: Candidates scored at a time.
ROWS = 512


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): usable vectors with components floor(scale * x), as whole doubles."""
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def _scores(queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; doubles hold them exactly if `exact`, else integers of any size are used."""
    if exact:
        return (queries @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object)
    product = whole(queries).dot(whole(rows).T)
    if any(abs(x) >= 1 << 62 for x in product.ravel()):
        raise ArithmeticError("a score does not fit 62 bits")
    return product.astype(np.int64)


class _Block:
    """Queries of a block, and what is known of their k-th scores.

    lo, hi: the range of the k-th best score; need: its rank within the range.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, limit: int, k: int, exact: bool):
        self.ids, self.queries, self.exact, self.k = ids, queries, exact, k
        self.lo = np.full(len(ids), -limit, np.int64)
        self.hi = np.full(len(ids), limit, np.int64)
        self.need = np.full(len(ids), k, np.int64)

    @property
    def width(self) -> np.ndarray:
        return (self.hi - self.lo) // BINS + 1

    def parts(self, batches):
        """(ids, scores, who may count) of candidates, some rows at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column("id").to_numpy()
                rows = matrix(part.column("v"), self.queries.shape[1])
                yield ids, _scores(self.queries, rows, self.exact), self.ids[:, None] != ids[None, :]

    def histogram(self, candidates: DataFrame) -> DataFrame:
        def run(batches):
            total = np.zeros(len(self.ids) * BINS, np.int64)
            base, width = np.arange(len(self.ids))[:, None] * BINS, self.width[:, None]
            for _, score, counts in self.parts(batches):
                counts &= (score >= self.lo[:, None]) & (score <= self.hi[:, None])
                total += np.bincount((base + (score - self.lo[:, None]) // width)[counts], minlength=len(total))
            total = total.reshape(-1, BINS)
            # A task's own k-th bin bounds the k-th bin of all tasks from below.
            above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
            query, at = np.nonzero((total > 0) & (above < self.need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(at), pa.array(total[query, at])], names=["query", "bin", "count"])

        return candidates.mapInArrow(run, "query long, bin long, count long").groupBy("query", "bin").agg(F.sum("count").alias("count"))

    def refine(self, candidates: DataFrame) -> None:
        """One round: narrow each query's range to the bin of its k-th score."""
        down = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        sums = self.histogram(candidates).withColumn("upto", F.sum("count").over(down))
        wanted = candidates.sparkSession.createDataFrame(list(enumerate(self.need.tolist())), "query long, need long")
        hit = sums.join(F.broadcast(wanted), "query").filter("upto >= need and upto - count < need").select("query", "bin", (F.col("upto") - F.col("count")).alias("above"))
        found = hit.collect()  # one row per query of the block
        width, seen = self.width, np.zeros(len(self.ids), bool)
        lo, hi = self.lo.copy(), self.hi.copy()
        for r in found:
            q = r.query
            seen[q] = True
            lo[q] = self.lo[q] + r.bin * width[q]
            hi[q] = min(self.hi[q], lo[q] + width[q] - 1)
            self.need[q] -= r.above
        hi[~seen] = lo[~seen]  # fewer than k candidates: all of them count
        self.lo, self.hi = lo, hi

    def best(self, candidates: DataFrame) -> DataFrame:
        """(query_id, id, score) of all candidates that may be among the k best."""

        def run(batches):
            ties: dict[int, list[int]] = {}
            for ids, score, counts in self.parts(batches):
                query, row = np.nonzero(counts & (score > self.lo[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(ids[row]), pa.array(score[query, row])], names=["query_id", "id", "score"])
                query, row = np.nonzero(counts & (score == self.lo[:, None]))
                for q in np.unique(query):
                    ties[q] = sorted([*ties.get(q, []), *ids[row[query == q]].tolist()])[: self.k]
            flat = [(self.ids[q], i, self.lo[q]) for q, found in ties.items() for i in found]
            query, ids, score = map(list, zip(*flat)) if flat else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "id", "score"])

        return candidates.mapInArrow(run, "query_id long, id long, score long")


def search(vectors: DataFrame, is_query: str, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of each query.

    `is_query` is a condition on `id` that tells queries; all rows are
    candidates. See the module's docstring.
    """
    candidates = written(quantised(vectors, id_col, vector_col, scale), "topk-vectors")
    facts = candidates.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    dim, most = facts.dim or 0, int(facts.most or 0)
    limit = max(1, dim * most * most)
    exact = limit < 1 << 53
    queries = candidates.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "topk-queries")
    path = shared_dir(vectors.sparkSession, "topk-found")
    for b in range(blocks):
        rows = queries.filter(F.col("block") == b).orderBy("id").select("id", "v").toArrow()  # about BLOCK rows
        ids = rows.column("id").to_numpy().astype(np.int64)
        block = _Block(ids, matrix(rows.column("v"), dim), min(limit, (1 << 62) - 1), k, exact)
        while len(ids) and (block.hi > block.lo).any():
            block.refine(candidates)
        # Each block's result is kept in one table, so that the plan stays the same for any number of blocks.
        block.best(candidates).write.mode("append").parquet(path)
    found = vectors.sparkSession.read.schema("query_id long, id long, score long").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
