"""Query op1: every whole text of `documents` to ids and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm import bpe
from queuelens.llm.common import table

FILE = "word_bpe_49k.json"


def digests(docs: DataFrame, path: str) -> DataFrame:
    coded = bpe.encode(docs.select("doc_id", "text"), path).drop("text")
    coded = coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        "ids",
    )
    return bpe.decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(FILE))
