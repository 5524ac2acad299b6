"""Query op11: the runs of repeated words of every text, some of which are made periodic first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm import runs
from queuelens.llm.common import table

ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as given from documents
), h as (
  select doc_id, given, len(given) as n, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda z: ord(z)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)), 4294967295::bigint) as h from d
), m as (
  select doc_id, given, n, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a, h // 10 as g from h
), w as (
  select doc_id, n, case when a is null then given else list_transform(range(0, n), lambda i: case when i >= a then given[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] else given[i + 1] end) end as w from m
), x as (
  select doc_id, n, unnest(w) as word, unnest(range(0, n)) as i from w
), e as (
  select x.doc_id, x.i, y.i - x.i as p from x join x y on y.doc_id = x.doc_id and y.word = x.word and y.i > x.i and 4 * (y.i - x.i) <= x.n
), s as (
  select doc_id, p, i, i - row_number() over (partition by doc_id, p order by i) as island from e
), r as (
  select doc_id, min(i) as start, count(*) + p as length, p from s group by doc_id, p, island having count(*) + p >= greatest(6, 4 * p)
), u as (
  select doc_id, start, length, min(p) as period from r group by all
), dropped as (
  select distinct doc_id, unnest(range(start + period, start + length)) as i from u
), c as (
  select doc_id, string_agg(word, ' ' order by i) as kept from x anti join dropped using (doc_id, i) group by 1
), b as (
  select * from u qualify row_number() over (partition by doc_id order by length::double / period desc, start, period) = 1
), g as (
  select doc_id, count(*) as n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as listed from u group by 1
)
select w.doc_id, coalesce(n_runs, 0) as n_runs, b.start, b.length, b.period, 1000 * b.length // b.period as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from w left join b using (doc_id) left join g using (doc_id) left join c using (doc_id)
"""


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by the id's checksum, is periodic from some word on. Rows without an id stay."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    seen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w").cast("long"))
    seen = seen.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    seen = seen.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.array_join(F.expr("transform(w, (x, i) -> if(i >= a, w[cast(a + (i - a) % p as int)], x))"), " ")
    return seen.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""
    found = runs.runs(planted(table(spark, sf_dir, "documents"))).drop("text")
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    seen = found.withColumn("best", best).withColumn("listed", F.array_join(lines, ""))
    return seen.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
