"""Query op2: a quality score for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm import quality
from queuelens.llm.common import table

GOOD = 0.3


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, held_out, score, predicted for each document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
