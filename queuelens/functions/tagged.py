"""Tagged JSON values: of one value as Catalyst expressions over strings, of nested ones as rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.sources.shared import written

# The tags of encoded values.
DATETIME, DATE, TIME, RESULT = "__datetime__", "__date__", "__time__", "__task_result__"


def kind(value: Column) -> Column:
    """datetime, date, time, result, or plain; null for text that is no JSON."""
    keys = F.json_object_keys(value)
    has = lambda tag: F.coalesce(F.array_contains(keys, tag), F.lit(False))
    tagged = F.when(has(DATETIME), "datetime").when(has(DATE), "date").when(has(TIME), "time").when(has(RESULT), "result").otherwise("plain")
    return F.when(F.try_parse_json(value).isNotNull(), tagged)


def _member(value: Column, tag: str) -> Column:
    # Encoders write {tag: true, "value": ...}; the bare {tag: text} is read as well.
    return F.coalesce(F.get_json_object(value, "$.value"), F.get_json_object(value, f"$.{tag}"))


def as_timestamp(value: Column) -> Column:
    return F.when(kind(value) == "datetime", F.try_to_timestamp(_member(value, DATETIME)))


def as_date(value: Column) -> Column:
    return F.when(kind(value) == "date", F.try_to_timestamp(_member(value, DATE)).cast("date"))


def encode_timestamp(ts: Column) -> Column:
    return F.to_json(F.struct(F.lit(True).alias(DATETIME), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("value")))


def result(ok: Column, err: Column) -> Column:
    """STRUCT<ok, err> of raw JSON texts from an encoded result, and back by `encode_result`."""
    return F.struct(ok.alias("ok"), err.alias("err"))


def decode_result(value: Column) -> Column:
    """The ok and err members of an encoded result, as JSON text; nulls for other values."""
    ok, err = F.get_json_object(value, "$.ok"), F.get_json_object(value, "$.err")
    return F.when(kind(value) == "result", result(ok, err))


def encode_result(ok: Column, err: Column) -> Column:
    """JSON texts of value and error as one tagged text."""
    return F.concat(F.lit(f'{{"{RESULT}":true,"ok":'), F.coalesce(ok, F.lit("null")), F.lit(',"err":'), F.coalesce(err, F.lit("null")), F.lit("}"))


def _truthy(tag: str) -> str:
    """SQL: whether an object has a tag that is not false, zero or empty."""
    value = f"""get_json_object(concat('[', json, ']'), '$[*].{tag}')"""
    return f"""coalesce({value} not in ('false', '0', '0.0', '""', '[]', '{{}}'), false)"""


#: The tags of values whose class only their program knows.
MODEL, DATACLASS = "__pydantic_model__", "__dataclass__"
#: Tags hold two underscores, plain or escaped; other objects are not searched for them.
_KIND = r"when not contains(json, '__') and not contains(json, '\\') then 'object' " + " ".join(f"when {_truthy(tag)} then '{name}'" for tag, name in ((MODEL, "model"), (DATACLASS, "dataclass"), (DATETIME, "datetime"), (DATE, "date"), (TIME, "time"), (RESULT, "result")))
#: What the text of a date, a time and an instant looks like.
_SHAPE = {"date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "time": r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\\.[0-9]{1,6})?)?([+-][0-9]{2}:[0-9]{2}|Z)?$"}


def nested(values: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, value, damaged): all values inside JSON texts, at any depth, one row each.

    Tagged values are one row: instants, dates and times with their text, models
    and dataclasses with their whole JSON. A result is gone through by its ok
    part; one with an error is one row, its error not gone through. Objects with
    unknown tags are plain objects. Plain values are rows of kind `plain` with
    their JSON, as are empty objects and lists. `damaged` is true where a tagged
    text can't be read; for a text that is no JSON there is one row without kind.
    Null texts give no rows. Rows keep their key, also repeated ones.

    One level of nesting is opened in a round; a round reads only what is open.
    """
    spark = values.sparkSession
    given = values.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lit("$").alias("path"), F.col(text).alias("json"))
    level = given.withColumn("json", F.when(F.try_parse_json("json").isNotNull(), F.col("json")))
    broken = level.filter("json is null").select("key", "path", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("damaged"))
    found = [broken]
    level = level.filter("json is not null")
    while True:
        kind = F.expr(f"case when startswith(ltrim(json), '{{') then case {_KIND} else 'object' end when startswith(ltrim(json), '[') then 'list' else 'plain' end")
        seen = level.withColumn("kind", kind)
        failed = F.expr("get_json_object(concat('[', json, ']'), '$[*].err')").isNotNull()
        inner = F.when((F.col("kind") == "result") & ~failed, F.expr("coalesce(get_json_object(concat('[', json, ']'), '$[*].ok'), 'null')"))
        empty = F.col("kind").isin("object", "list") & (F.regexp_replace("json", r"\s", "").isin("{}", "[]"))
        state = written(seen.withColumns({"inner": inner, "open": F.col("kind").isin("object", "list") & ~empty}), "tagged-level")
        member = F.get_json_object("json", "$.value")
        stamp = F.col("kind").isin("datetime", "date", "time")
        wrong = F.when(F.col("kind") == "datetime", F.try_to_timestamp(member).isNull()).when(F.col("kind") == "date", ~member.rlike(_SHAPE["date"]) | F.try_to_timestamp(member).isNull()).when(F.col("kind") == "time", ~member.rlike(_SHAPE["time"]))
        wrong = F.when(stamp, F.coalesce(wrong, F.lit(True))).otherwise(False)
        plain = F.when(F.col("kind").isin("object", "list"), "plain").otherwise(F.col("kind"))
        found.append(state.filter("not open and inner is null").select("key", "path", plain.alias("kind"), F.when(stamp, member).otherwise(F.col("json")).alias("value"), wrong.alias("damaged")))
        results = state.filter("inner is not null").select("key", F.concat("path", F.lit(".ok")).alias("path"), F.col("inner").alias("json"))
        below = spark.sql("select t.key, concat(t.path, coalesce(concat('.', e.key), concat('[', e.pos, ']'))) as path, coalesce(to_json(e.value), 'null') as json from {open} t, lateral variant_explode(parse_json(t.json)) e", open=state.filter("open"))
        level = below.unionByName(results)
        if not level.limit(1).count():
            return functools.reduce(DataFrame.unionByName, found).withColumnRenamed("key", key)
