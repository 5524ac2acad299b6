"""Query op10: near-duplicate embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from queuelens.llm.common import table
from queuelens.llm.nndescent import near_duplicates

ORACLE = """
with recursive v as (
  select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), e as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9
), r as (
  select vec_id, vec_id as root from embeddings union select e.y, r.root from r join e on e.x = r.vec_id
), c as (
  select vec_id, min(root) as component_id from r group by 1
)
select vec_id, (select count(*) from e where e.x = c.vec_id) as n_links, component_id, vec_id = component_id as kept from c
"""


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns vec_id, n_links, component_id, kept for each vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
