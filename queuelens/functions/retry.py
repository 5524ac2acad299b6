"""Retry policies as Catalyst expressions over the task's options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions.times import seconds

OPTIONS = "struct<retry_policy: struct<intervals: array<int>, backoff_strategy: string, jitter: boolean>, auto_retry_for: array<string>>"
#: The delays of a task without a policy, in seconds.
INTERVALS = (60, 300, 900)


def retry_delay(attempt: Column, intervals: Column | None = None, strategy: Column | None = None, jitter: Column | None = None) -> Column:
    """Seconds before retry number `attempt` (from 1); at least 1.

    "fixed" takes the attempt's interval, the last one from then on;
    "exponential" doubles the first one. `jitter` is a number from -0.25 to
    0.25, or None.
    """
    given = F.array(*[F.lit(n) for n in INTERVALS])
    own = given if intervals is None else F.when(F.coalesce(F.size(intervals), F.lit(0)) > 0, intervals).otherwise(given)
    fixed = F.element_at(own, F.least(attempt, F.size(own))).cast("double")
    doubled = F.element_at(own, 1) * F.pow(F.lit(2.0), attempt - 1)
    delay = fixed if strategy is None else F.when(strategy == "exponential", doubled).otherwise(fixed)
    delay = delay if jitter is None else delay * (1 + jitter)
    return F.greatest(F.lit(1.0), delay)


def can_retry(as_of: Column, code: Column, options: Column) -> Column:
    """Retries are left, the policy names the error code, and the deadline is ahead."""
    left = (F.col("max_retries") > 0) & (F.col("retry_count") < F.col("max_retries"))
    named = F.coalesce(F.array_contains(options["auto_retry_for"], code), F.lit(False))
    return left & named & (F.col("good_until").isNull() | (F.col("good_until") > as_of))


def retry_plan(tasks: DataFrame, as_of: Column, options: Column, code: Column) -> DataFrame:
    """Tasks with verdict (none, scheduled, expired), delay in seconds, and next_retry_at."""
    policy = options["retry_policy"]
    delay = F.floor(retry_delay(F.col("retry_count") + 1, policy["intervals"], policy["backoff_strategy"])).cast("bigint")
    at = as_of + seconds(delay)
    verdict = F.when(~can_retry(as_of, code, options), "none").when(F.col("good_until").isNotNull() & (at >= F.col("good_until")), "expired").otherwise("scheduled")
    planned = tasks.withColumn("verdict", verdict).withColumn("delay_seconds", F.when(F.col("verdict") == "scheduled", delay))
    return planned.withColumn("retry_at", F.when(F.col("verdict") == "scheduled", at))


def error_code(by_class: dict[str, str], given: Column, default: str | None, task: dict[str, str] | None = None) -> Column:
    """Code of an exception class: the task's mapping, then the global one, then the default."""
    out = F.lit(default)
    for mapping in (by_class, task or {}):
        for name, code in mapping.items():
            out = F.when(given == name, code).otherwise(out)
    return out


def reconnect_delay(attempt: int, first: float = 1.0, most: float = 60.0, jitter: float = 0.0) -> float:
    """Seconds before the driver connects to a database again."""
    return max(0.1, min(most, first * 2**attempt) * (1 + jitter))
