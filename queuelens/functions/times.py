"""Instants and durations as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(n: int | Column) -> Column:
    """A duration of n seconds."""
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, n if isinstance(n, Column) else F.lit(n))


def ago(as_of: Column, n: int) -> Column:
    return as_of - seconds(n)


def _whole_seconds(instant: Column | str) -> Column:
    """Seconds since 1970, downwards."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(instant) if isinstance(instant, str) else instant)
    return F.call_function("div", micros - F.pmod(micros, F.lit(1_000_000)), F.lit(1_000_000))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """How often a new second has begun from start to end, as DuckDB's date_diff; parts of seconds make no difference."""
    return _whole_seconds(end) - _whole_seconds(start)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where the whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def rounded(value: Column, places: int) -> Column:
    """Half away from zero, through a decimal, as a double."""
    return F.round(value.cast("decimal(38,10)"), places).cast("double")


def duration_text(secs: Column) -> Column:
    """Seconds as "42s", "3m 5s", "2h 7m"; "-" for null."""
    text = lambda c: c.cast("bigint").cast("string")
    minutes, hours = F.floor(secs / 60), F.floor(secs / 3600)
    return (
        F.when(secs.isNull(), "-")
        .when(secs < 60, F.concat(text(secs), F.lit("s")))
        .when(secs < 3600, F.concat(text(minutes), F.lit("m "), text(secs % 60), F.lit("s")))
        .otherwise(F.concat(text(hours), F.lit("h "), text(F.floor((secs % 3600) / 60)), F.lit("m")))
    )
