"""User functions as tasks: Arrow batches in, tagged results out."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Functions by the name of their task. Names are unique.
REGISTRY: dict[str, Callable] = {}


def column(name: str, fn: Callable, ok: str = "bigint", codes: dict[str, str] | None = None, default: str = "UNHANDLED_EXCEPTION") -> Callable[..., Column]:
    """A row function as a column function that returns STRUCT<ok, err>.

    A value becomes `ok`; None is the error TASK_RETURNED_NONE; an exception
    is mapped to a code by its class. Another function of a known name is an
    error.
    """
    if REGISTRY.setdefault(name, fn) is not fn:
        raise ValueError(f"another task is named {name}")
    mapping = dict(codes or {})

    def one(args: tuple) -> tuple:
        try:
            value = fn(*args)
        except Exception as e:  # what a task raises is its result
            return None, {"code": mapping.get(type(e).__name__, default), "message": str(e)}
        if value is None:
            return None, {"code": "TASK_RETURNED_NONE", "message": "no value"}
        return value, None

    def batch(*columns: pd.Series) -> pd.DataFrame:
        values, errors = zip(*[one(args) for args in zip(*columns)]) if len(columns[0]) else ((), ())
        empty = {"code": None, "message": None}
        return pd.DataFrame({"ok": pd.Series(values, dtype=object), "err": pd.DataFrame([e or empty for e in errors], columns=["code", "message"]).to_dict("records")})

    return F.pandas_udf(batch, f"ok {ok}, err struct<code: string, message: string>")


def register(spark: SparkSession, name: str, call: Callable[..., Column]) -> None:
    """Make a task available to SQL under its name."""
    spark.udf.register(name, call)
