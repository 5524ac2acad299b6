"""Query op6: documents linked by the Jaccard similarity of their word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from queuelens.llm import jaccard
from queuelens.llm.common import table

ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) end) as g from d
), n as (
  select doc_id, count(*) as k from s group by 1
), p as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), l as (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.k + b.k - c)
), e as (
  select x, y from l union all select y, x from l
), r as (
  select doc_id, doc_id as root from d union select e.y, r.root from r join e on e.x = r.doc_id
)
select doc_id, coalesce(any_value(k), 0) as n_shingles, min(root) as component_id from r left join n using (doc_id) group by doc_id
"""


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_shingles, component_id for each document."""
    return jaccard.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
