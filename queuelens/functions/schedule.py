"""Schedule arithmetic in Catalyst: the next run of a pattern in a time zone.

Instants are `timestamp_ntz` columns in UTC. A local time that a clock change
leaves out is skipped; of one that occurs twice the earlier instant counts.
Candidates are compared as instants, so a run never lies before the time it
is computed from, also within a repeated hour.

A pattern is a Python object, or a column of the struct `PATTERN` (by `type`
some of its fields count, as in `pattern_of`), its time zone a name or a
column: a table of schedules has its own for each row. A row whose pattern or
zone is null has no next run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions import ids
from queuelens.functions.times import seconds

#: Weekdays as Spark numbers them.
WEEKDAYS = {d: i for i, d in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))}


@dataclass(frozen=True)
class Interval:
    """Every so many seconds."""

    seconds: int


@dataclass(frozen=True)
class Hourly:
    minute: int = 0
    second: int = 0


@dataclass(frozen=True)
class Daily:
    hour: int
    minute: int = 0
    second: int = 0


@dataclass(frozen=True)
class Weekly:
    days: tuple[str, ...]
    hour: int
    minute: int = 0
    second: int = 0


@dataclass(frozen=True)
class Monthly:
    day: int
    hour: int = 0
    minute: int = 0
    second: int = 0


Pattern = Interval | Hourly | Daily | Weekly | Monthly

#: A pattern as a column. Intervals sum up their units; times are HH:MM:SS.
PATTERN = "struct<type: string, seconds: int, minutes: int, hours: int, days: int, minute: int, second: int, weekdays: array<string>, day: int, time: string>"


def _fields(pattern: Pattern) -> dict:
    """The fields of a pattern, in the order of its settings."""
    kind = type(pattern).__name__.lower()
    if isinstance(pattern, Interval):
        return {"type": kind, "seconds": pattern.seconds, "minutes": None, "hours": None, "days": None}
    if isinstance(pattern, Hourly):
        return {"type": kind, "minute": pattern.minute, "second": pattern.second}
    time = {"time": f"{pattern.hour:02}:{pattern.minute:02}:{pattern.second:02}"}
    if isinstance(pattern, Weekly):
        return {"type": kind, "weekdays": list(pattern.days)} | time
    return {"type": kind} | ({"day": pattern.day} if isinstance(pattern, Monthly) else {}) | time


def pattern_of(pattern: Pattern) -> Column:
    """A pattern as a constant column."""
    import json

    return F.from_json(F.lit(json.dumps(_fields(pattern))), PATTERN)


def _zone(tz: str | Column) -> Column:
    return F.lit(tz) if isinstance(tz, str) else tz


def to_utc(local: Column, tz: str | Column) -> Column:
    return F.convert_timezone(_zone(tz), F.lit("UTC"), local)


def to_local(utc: Column, tz: str | Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), _zone(tz), utc)


def _interval_seconds(pattern: Column) -> Column:
    unit = lambda name, n: F.coalesce(pattern[name], F.lit(0)).cast("long") * n
    return unit("seconds", 1) + unit("minutes", 60) + unit("hours", 3600) + unit("days", 86400)


def _any_candidates(pattern: Column, local: Column) -> Column:
    """`_candidates` of a pattern that is a column."""
    day = F.to_date(local)
    clock = F.aggregate(F.split(pattern["time"], ":"), F.lit(0), lambda a, x: a * 60 + x.cast("int"))
    at = lambda d, n: d.cast("timestamp_ntz") + seconds(n)
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), F.lit(n)), f)
    hourly = upto(5, lambda i: at(day, (F.hour(local) + i) * 3600 + pattern["minute"] * 60 + pattern["second"]))
    daily = upto(7, lambda i: at(F.date_add(day, i), clock))
    names = F.transform(pattern["weekdays"], lambda d: F.create_map(*[F.lit(x) for pair in WEEKDAYS.items() for x in pair])[d])
    weekly = F.transform(F.filter(upto(14, lambda i: F.date_add(day, i)), lambda d: F.array_contains(names, F.weekday(d))), lambda d: at(d, clock))
    first = F.trunc(day, "MM")
    months = F.filter(upto(24, lambda k: F.add_months(first, k)), lambda m: F.day(F.last_day(m)) >= pattern["day"])
    monthly = F.transform(months, lambda m: at(F.date_add(m, pattern["day"] - 1), clock))
    kind = pattern["type"]
    return F.when(kind == "hourly", hourly).when(kind == "daily", daily).when(kind == "weekly", weekly).when(kind == "monthly", monthly)


def _candidates(pattern: Pattern, local: Column) -> Column:
    """Local times, in order, of which the first valid one after now is the next run."""
    at = lambda day, n: day.cast("timestamp_ntz") + seconds(n)
    day = F.to_date(local)
    if isinstance(pattern, Hourly):
        hours = F.hour(local) * 3600
        return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: day.cast("timestamp_ntz") + seconds(hours + i * 3600 + pattern.minute * 60 + pattern.second))
    clock = pattern.hour * 3600 + pattern.minute * 60 + pattern.second
    if isinstance(pattern, Daily):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: at(F.date_add(day, i), clock))
    if isinstance(pattern, Weekly):
        wanted = [WEEKDAYS[d] for d in pattern.days]
        days = F.filter(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.date_add(day, i)), lambda d: F.weekday(d).isin(*wanted))
        return F.transform(days, lambda d: at(d, clock))
    first = F.trunc(day, "MM")
    months = F.filter(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.add_months(first, k)), lambda m: F.day(F.last_day(m)) >= pattern.day)
    return F.transform(months, lambda m: at(F.date_add(m, pattern.day - 1), clock))


def next_run(pattern: Pattern | Column, start: Column, tz: str | Column = "UTC") -> Column:
    """The first run after `start` (UTC)."""
    if isinstance(pattern, Interval):
        return start + seconds(pattern.seconds)
    local = to_local(start, tz)
    valid = lambda x: (to_local(to_utc(x, tz), tz) == x) & (to_utc(x, tz) > start)
    found = _any_candidates(pattern, local) if isinstance(pattern, Column) else _candidates(pattern, local)
    run = F.array_min(F.transform(F.filter(found, valid), lambda x: to_utc(x, tz)))
    return F.when(pattern["type"] == "interval", start + seconds(_interval_seconds(pattern))).otherwise(run) if isinstance(pattern, Column) else run


def is_due(next_run_at: Column, now: Column) -> Column:
    """A schedule without a next run is due at once."""
    return next_run_at.isNull() | (next_run_at <= now)


def missed_runs(pattern: Pattern | Column, first: Column, now: Column, most: int | Column, tz: str | Column = "UTC") -> Column:
    """Array of the runs from `first` to `now`, both included, `most` of them at most."""
    none = F.array().cast("array<timestamp_ntz>")
    if isinstance(pattern, Interval) and isinstance(most, int):
        last = F.least(now, first + seconds(pattern.seconds * (most - 1)))
        return F.when(first <= now, F.sequence(first, last, seconds(pattern.seconds))).otherwise(none)

    def step(found: Column, _: Column) -> Column:
        following = next_run(pattern, F.element_at(found, -1), tz)
        return F.when(following <= now, F.concat(found, F.array(following))).otherwise(found)

    most = F.lit(most) if isinstance(most, int) else most
    rounds = F.when(most > 1, F.sequence(F.lit(1), most - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(first <= now, F.aggregate(rounds, F.array(first), step)).otherwise(none)


def config_hash(pattern: Pattern, tz: str) -> str:
    """Hash of a schedule's settings; a change asks for a new next run."""
    import hashlib
    import json

    fields = {("days" if k == "weekdays" else k): {"__time__": True, "value": v} if k == "time" else v for k, v in _fields(pattern).items()}
    return hashlib.sha256(json.dumps({"pattern": fields, "timezone": tz}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def config_hash_of(pattern: Column, tz: Column) -> Column:
    """`config_hash` of a pattern and zone that are columns."""
    number = lambda name: F.coalesce(pattern[name].cast("string"), F.lit("null"))
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    time = part(',"time":{"__time__":true,"value":"', pattern["time"], '"}')
    kind = pattern["type"]
    body = (
        F.when(kind == "interval", part(',"seconds":', number("seconds"), ',"minutes":', number("minutes"), ',"hours":', number("hours"), ',"days":', number("days")))
        .when(kind == "hourly", part(',"minute":', number("minute"), ',"second":', number("second")))
        .when(kind == "daily", time).when(kind == "weekly", part(',"days":', F.to_json(pattern["weekdays"]), time)).when(kind == "monthly", part(',"day":', number("day"), time))
    )
    return F.sha2(part('{"pattern":{"type":"', kind, '"', body, '},"timezone":"', tz, '"}'), 256)


def due_schedules(state: DataFrame, now: Column) -> DataFrame:
    due = state.filter(is_due(F.col("next_run_at"), now))
    return due.orderBy(F.asc_nulls_last("next_run_at"), "schedule_name")


def slots(state: DataFrame, pattern: Pattern, now: Column, tz: str = "UTC", catch_up: int = 0) -> DataFrame:
    """The state with `slots`, the runs that are due: the next one (or now, if there is none), with catch-up all missed ones."""
    due = is_due(F.col("next_run_at"), now)
    first = F.coalesce("next_run_at", now)
    found = missed_runs(pattern, first, now, catch_up, tz) if catch_up else F.array(first)
    return state.withColumn("slots", F.when(due, found).otherwise(F.array().cast("array<timestamp_ntz>")))


def tick(state: DataFrame, pattern: Pattern, now: Column, tz: str = "UTC", catch_up: int = 0, done: Column | None = None) -> DataFrame:
    """State after one pass: due schedules ran, and have a new next run. `slots` are the runs that were enqueued.

    With catch-up they go on from the last slot that was enqueued, else from
    now. `done` is how many of the slots, in order, were; of a schedule with
    none the state stays, so that the next pass tries again.
    """
    ran = slots(state, pattern, now, tz, catch_up)
    ran = ran if done is None else ran.withColumn("slots", F.slice("slots", F.lit(1), F.greatest(F.lit(0), done.cast("int"))))
    some = F.size("slots") > 0
    start = F.try_element_at("slots", F.lit(-1)) if catch_up else now
    changes = {"last_run_at": F.when(some, now).otherwise(F.col("last_run_at")), "next_run_at": F.when(some, next_run(pattern, start, tz)).otherwise(F.col("next_run_at")), "run_count": F.col("run_count") + some.cast("int")}
    more = {"updated_at": now, "last_task_id": ids.slot_id(F.col("schedule_name"), F.try_element_at("slots", F.lit(-1)))}
    return ran.withColumns(changes | {c: F.when(some, v).otherwise(F.col(c)) for c, v in more.items() if c in state.columns})


def tick_all(state: DataFrame, schedules: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(state, runs) after one pass over all schedules, each with its own pattern, time zone and way to catch up.

    `schedules` has schedule_name, pattern (`PATTERN`), timezone, enabled,
    catch_up_missed and max_catch_up_runs. Due ones run: the next run (now, if
    there is none) or, catching up, all missed runs up to the maximum; `runs`
    has (schedule_name, slot, task_id), the id being the same in every pass.
    Schedules that are not enabled, or not in `schedules`, keep their state, and
    so do those whose pattern or zone is null.
    """
    wanted = schedules.filter("enabled and pattern is not null and timezone is not null").dropDuplicates(["schedule_name"])
    wanted = wanted.select("schedule_name", F.col("pattern").alias("_pattern"), F.col("timezone").alias("_tz"), F.when(F.col("catch_up_missed"), F.greatest("max_catch_up_runs", F.lit(1))).otherwise(F.lit(0)).alias("_most"))
    seen = state.join(wanted, "schedule_name", "left")
    due = F.col("_tz").isNotNull() & is_due(F.col("next_run_at"), now)
    first = F.coalesce("next_run_at", now)
    found = F.when(F.col("_most") > 0, missed_runs(F.col("_pattern"), first, now, F.col("_most"), F.col("_tz"))).otherwise(F.array(first))
    ran = seen.withColumn("slots", F.when(due, found).otherwise(F.array().cast("array<timestamp_ntz>")))
    last = F.try_element_at("slots", F.lit(-1))
    some = last.isNotNull()
    after = next_run(F.col("_pattern"), F.when(F.col("_most") > 0, last).otherwise(now), F.col("_tz"))
    set_ = lambda new, old: F.when(some, new).otherwise(F.col(old)).alias(old)
    changed = {"last_run_at": now, "next_run_at": after, "run_count": F.col("run_count") + 1, "last_task_id": ids.slot_id(F.col("schedule_name"), last), "updated_at": now}
    out = ran.select("*", *[set_(v, c).alias(f"_new_{c}") for c, v in changed.items() if c in state.columns])
    runs = ran.select("schedule_name", F.explode("slots").alias("slot")).withColumn("task_id", ids.slot_id(F.col("schedule_name"), F.col("slot")))
    return out.select(*[F.col(f"_new_{c}").alias(c) if c in changed else F.col(c) for c in state.columns]), runs


def sync(state: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """The state brought in line with the configured schedules, `wanted` (schedule_name, config_hash, next_run).

    New schedules get a row, changed ones a new next run and hash, those no
    longer configured lose theirs, all others stay.
    """
    config = wanted.select("schedule_name", F.col("config_hash").alias("_hash"), F.col("next_run").alias("_next"), F.lit(True).alias("_wanted"))
    both = state.withColumn("_known", F.lit(True)).join(config, "schedule_name", "full_outer").filter("_wanted")
    changed = ~F.col("config_hash").eqNullSafe(F.col("_hash"))
    new = {"next_run_at": F.when(changed, F.col("_next")).otherwise(F.col("next_run_at")), "config_hash": F.col("_hash"), "updated_at": F.when(changed, now).otherwise(F.col("updated_at")), "run_count": F.coalesce("run_count", F.lit(0))}
    return both.withColumns(new).select(state.columns)

