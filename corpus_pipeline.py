"""A training corpus from `documents`, in four stages.

1. quality: documents that the quality classifier rejects go;
2. dedup: of each group of near copies (shingles of five words, Jaccard
   similarity of 0.8 or more) the document with the smallest doc_id stays;
3. pii: personal data is replaced by its kind in brackets;
4. packing: what is left is packed into sequences of 2048 tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next one. All stages but the last return the
columns that `docs` has. Null, empty and very long texts, repeated rows and
null ids are treated as the operators' docstrings say; further columns of any
name pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm import jaccard, pii, quality
from queuelens.llm.common import fresh, small_enough, table, written
from queuelens.llm.op2_quality import GOOD
from queuelens.llm.op3_packing import END_ID, FILE
from queuelens.llm.packing import pack
from queuelens.sources.shared import clear, scope


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at `GOOD` or more."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return quality.score(docs, model, "text", score).filter(F.col(score) >= GOOD).select(docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Where doc_ids are repeated or null, rows get keys first, and of each group
    the row with the smallest key stays.
    """
    key, keyed = "doc_id", docs
    repeated = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if repeated.limit(1).count():
        key = fresh(docs, "key")
        keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-keyed")
    found = jaccard.join(keyed.select(F.col(key).alias("doc_id"), "text"), n=5, num=80, den=100)
    other = fresh(keyed, "gone")
    gone = written(found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(other)), "pipeline-gone")
    if small_enough(gone, jaccard.BROADCAST_ROWS):
        gone = F.broadcast(gone)
    return keyed.join(gone, F.col(key) == F.col(other), "left_anti").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; null texts stay null."""
    own = {f.name for f in pii.FIELDS}
    aside = {c: fresh(docs, f"own_{c}") for c in docs.columns if c.lower() in own}
    out = pii.find(docs.withColumnsRenamed(aside), "text")
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("redacted")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("pii") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path(FILE), END_ID).drop("ids")


STAGES = [("quality", keep_good), ("dedup", keep_one), ("pii", redact), ("packing", sequences)]
#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written goes as soon as the next one is written."""
    docs = table(spark, sf_dir, "documents")
    with scope():
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            clear(spark, keep=1)
    return docs
