"""Query op5: personal data in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm import pii
from queuelens.llm.common import table


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, the number of spans of each kind, base_sha256, spans."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[pii.count(F.col("pii"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(F.col("pii_base")), 256).alias("base_sha256"),
        pii.joined(F.col("pii")).alias("spans"),
    )
