"""Query op7: all pages written as WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm import warc
from queuelens.llm.common import shared_dir, table

ORACLE = """
with base as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), ranked as (
  select *, min(page_id) over (partition by payload_digest) as first from base
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from ranked
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns page_id, payload_bytes, payload_digest, record_type, refers_to for each page."""
    path = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.assemble(warc.read(spark, path, payloads=False))
    number = lambda name: F.expr(f"try_cast(metadata.fields['{name}'] as bigint)")
    again = F.col("response.type") == "revisit"
    return found.select(
        number("page-id").alias("page_id"),
        F.when(again, number("payload-bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").cast("long").alias("refers_to"),
    )
