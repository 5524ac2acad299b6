"""Query op8: the five best partners of every fiftieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm import topk
from queuelens.llm.common import table

ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select * from r where rank <= 5
"""


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns query_id, rank, vec_id, score."""
    found = topk.search(table(spark, sf_dir, "embeddings"), "id % 50 = 0", 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
