"""Which labels the quality model learns from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from queuelens.llm import quality
from queuelens.llm.common import table

SF = "/root/testdata/sf0.001"


def same(a: quality.Gam, b: quality.Gam) -> bool:
    """Models are equal but for the order in which rows were summed up."""
    x = np.random.default_rng(1).uniform(0, 5, (200, len(a.tables)))
    return np.allclose(a.raw(x), b.raw(x), atol=1e-6)


def test_the_bound_takes_the_smallest_hashes(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    first = labels.filter(F.col("quality").isNotNull() & ~quality.held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(40)
    few = labels.join(first, "doc_id", "left_semi")
    assert same(quality.learn(docs, labels, max_labels=40), quality.learn(docs, few))


def test_repeated_labels_count_by_their_mean(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), "toxic")
    doubled = labels.unionByName(labels)
    bad = labels.filter("quality = 0")
    conflicting = labels.unionByName(bad.withColumn("quality", F.lit(1.0)))  # a mean of a half is good
    good = labels.withColumn("quality", F.when(F.col("quality") == 0, 1.0).otherwise(F.col("quality")))
    assert same(quality.learn(docs, labels), quality.learn(docs, doubled))
    assert same(quality.learn(docs, conflicting), quality.learn(docs, good))


def test_held_out_labels_teach_nothing(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    changed = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert same(quality.learn(docs, labels), quality.learn(docs, changed))
