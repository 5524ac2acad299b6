"""Query op12: the best collocations of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from queuelens.llm import collocations
from queuelens.llm.common import table

ORACLE = r"""
with p as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents
), s as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) as g from p, (select unnest(range(1, 6)) as k) where len(w) >= k
), f as (
  select lang, k, g, count(*) as f from s group by all having count(*) >= 100
), t as (
  select lang, sum(len(w))::bigint as n from p group by 1
), c as (
  select f.lang, f.k, f.g, f.f as a, n, x.f as l, y.f as r, cut, (1000::hugeint * f.f * n) // (x.f::hugeint * y.f) as score
  from f join t using (lang), (select unnest(range(1, 5)) as cut), f x, f y
  where f.k >= 2 and cut < f.k and x.lang = f.lang and x.k = cut and x.g = f.g[1:cut] and y.lang = f.lang and y.k = f.k - cut and y.g = f.g[cut + 1 : f.k]
), b as (
  select * from c qualify row_number() over (partition by lang, g order by score, cut) = 1
), i as (
  select lang, unnest(list_transform(range(1, k - m + 2), lambda j: g[j : j + m - 1])) as g, f from f, (select unnest(range(2, 5)) as m) where m < k
), o as (
  select lang, g, max(f) as longer from i group by all
)
select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase, a, l, r, n, score::bigint as score
from b left join o using (lang, g) where longer is null or 100 * longer < 100 * a
qualify row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) <= 2000
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns lang, rank, phrase, a, l, r, n, score of the first 2,000 phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
