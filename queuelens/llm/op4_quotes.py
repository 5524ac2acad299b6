"""Query op4: all conversations in order of reply, without quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from queuelens.llm import quotes
from queuelens.llm.common import table

ORACLE = r"""
with recursive lines as (
  select c.conv_id, c.turn, md5(c.text) as message, c.rowid_ as msg, l.pos, l.line,
    length(regexp_replace(regexp_extract(l.line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) as level,
    regexp_replace(l.line, '^[ \t]*((?:>[ \t]?)+)', '') as content
  from (select *, row_number() over () as rowid_ from conversations) c,
    lateral (select unnest(string_split(coalesce(c.text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(c.text, ''), chr(10)), 1) as pos) l
), parsed as (
  select c.conv_id, c.turn, c.role, x.own
  from (select *, row_number() over () as rowid_ from conversations) c
  join (select msg, regexp_replace(coalesce(string_agg(content, chr(10) order by pos) filter (level = 0), ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') as own from lines group by msg) x on x.msg = c.rowid_
), quoted_lines as (
  select distinct conv_id, turn, message, pos, level, content from lines where conv_id is not null and turn is not null
), runs as (
  select *, sum(case when level = was then 0 else 1 end) over (partition by conv_id, turn, message order by pos) as run
  from (select *, lag(level) over (partition by conv_id, turn, message order by pos) as was from quoted_lines)
), normal as (
  select *, trim(regexp_replace(lower(content), '[ \t\r\n]+', ' ', 'g')) as plain from runs where level > 0
), passages as (
  select conv_id, turn, message, run, level, flat, coalesce(ls, []) as ls
  from (select conv_id, turn, message, run, level, trim(regexp_replace(lower(string_agg(content, ' ' order by pos)), '[ \t\r\n]+', ' ', 'g')) as flat, list(plain order by pos) filter (plain <> '') as ls from normal group by all)
  where flat <> ''
), originals as (
  select distinct conv_id, turn, list_transform(list_concat([own], regexp_split_to_array(own, '\n[ \t\r]*\n')), lambda u: trim(regexp_replace(lower(u), '[ \t\r\n]+', ' ', 'g'))) as units,
    list_filter(list_transform(string_split(own, chr(10)), lambda u: trim(regexp_replace(lower(u), '[ \t\r\n]+', ' ', 'g'))), lambda u: u <> '') as ls
  from parsed where conv_id is not null and turn is not null and own <> ''
), matches as (
  select p.conv_id, p.turn, p.message, p.run, o.conv_id as o_conv, o.turn as o_turn
  from passages p join originals o on list_contains(o.units, p.flat) or list_contains(list_transform(range(1, len(o.ls) - len(p.ls) + 2), lambda s: o.ls[s : s + len(p.ls) - 1] = p.ls), true)
), best as (
  select conv_id, turn, message, run, max(o_turn) filter (o_conv = conv_id and o_turn < turn) as near, min((o_conv, o_turn)) filter (o_conv <> conv_id) as f from matches group by all
), links as (
  select p.conv_id, p.turn, p.level, case when near is not null then p.conv_id else f[1] end as to_conv, case when near is not null then near else f[2] end as to_turn
  from passages p left join best b on b.conv_id = p.conv_id and b.turn = p.turn and b.message = p.message and b.run = p.run
), inside as (
  select *, min(level) over (partition by conv_id, turn) as outermost from links where to_conv = conv_id
), replies as (
  select conv_id, turn, max(to_turn) as quotes_turn from inside where level = outermost group by all
), counts as (
  select conv_id, turn, count(*) as n_quotes, count(to_conv) as n_linked from links group by all
), places as (
  select conv_id, turn, coalesce(quotes_turn, lag(turn) over (partition by conv_id order by turn)) as reply_to
  from (select distinct conv_id, turn from conversations where conv_id is not null and turn is not null) left join replies using (conv_id, turn)
), goes as (
  select *, reply_to is not null and turn = min(turn) over (partition by conv_id, reply_to) as goes_on from places
), walk as (
  select conv_id, turn, turn as branch, 0 as depth from goes where reply_to is null
  union all
  select g.conv_id, g.turn, case when g.goes_on then w.branch else g.turn end, w.depth + 1 from goes g join walk w on g.conv_id = w.conv_id and g.reply_to = w.turn
)
select p.conv_id, p.turn, p.role, p.own as text, coalesce(n_quotes, 0) as n_quotes, coalesce(n_linked, 0) as n_linked,
  reply_to, coalesce(branch, p.turn) as branch, cast(coalesce(depth, 0) as bigint) as depth
from parsed p left join places using (conv_id, turn) left join walk using (conv_id, turn) left join counts using (conv_id, turn)
"""


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns one row per message of `conversations`: see `quotes.conversations`."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))
