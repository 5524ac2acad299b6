"""Query op3: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import table
from queuelens.llm.packing import pack

FILE, END_ID = "byte_bpe_50k.json", 1


def pieces(docs: DataFrame) -> DataFrame:
    packed = pack(docs, public_tokenizers.path(FILE), END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.col("queue").alias("source"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    return pieces(table(spark, sf_dir, "documents"))
