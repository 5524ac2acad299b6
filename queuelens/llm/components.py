"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import written


def _state(edges: DataFrame) -> tuple[int, int]:
    """(number of edges, order-independent hash): equal when nothing changed."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for nodes with edges.

    `edges` has columns u and v of one orderable type. Large-star and
    small-star steps rewire the edges until all of them point to roots; the
    number of rounds grows with the logarithm of the nodes. Each step joins
    every edge with the minimum of one group, so no group is gathered, and each
    round's edges are written to the shared folder. Edges from a node to itself
    and repeated edges count for nothing; nulls are not allowed.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    state = _state(edges)
    while state[0]:
        # Large star: the larger neighbours of each node move to its least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of each node move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
