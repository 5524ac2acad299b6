"""Nested tagged values against a plain recursion."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, time

from queuelens.functions import tagged

READ = {"datetime": datetime.fromisoformat, "date": date.fromisoformat, "time": time.fromisoformat}


def walk(value, path="$"):
    if isinstance(value, dict):
        for tag, kind in (("__pydantic_model__", "model"), ("__dataclass__", "dataclass")):
            if value.get(tag):
                return [(path, kind, None, False)]
        for kind, read in READ.items():
            if value.get(f"__{kind}__"):
                try:
                    read(value["value"])
                    return [(path, kind, value["value"], False)]
                except (ValueError, KeyError):
                    return [(path, kind, value.get("value"), True)]
        if value.get("__task_result__"):
            return [(path, "result", None, False)] if value.get("err") is not None else walk(value.get("ok"), f"{path}.ok")
        if value:
            return [r for k, v in value.items() for r in walk(v, f"{path}.{k}")]
    if isinstance(value, list) and value:
        return [r for i, v in enumerate(value) for r in walk(v, f"{path}[{i}]")]
    return [(path, "plain", value, False)]


def grown(rng, depth):
    pick = rng.random()
    if depth == 0 or pick < 0.25:
        return rng.choice([1, -2, True, None, "x", "", "a\"b\\", "é", [], {}])
    if pick < 0.45:
        kind = rng.choice(["datetime", "date", "time", "future"])
        text = rng.choice({"datetime": ["2024-02-29T01:02:03+01:00", "2024-02-30T00:00:00"], "date": ["2024-02-29", "2024-02-30", "x"], "time": ["01:02:03", "25:00:00"], "future": ["y"]}[kind])
        return {f"__{kind}__": rng.choice([True, True, True, False]), "value": text}
    if pick < 0.55:
        return {"__task_result__": True, "ok": grown(rng, depth - 1), "err": None} if rng.random() < 0.7 else {"__task_result__": True, "ok": None, "err": {"error_code": "X"}}
    if pick < 0.6:
        return {rng.choice(["__pydantic_model__", "__dataclass__"]): True, "data": {"k": 1}}
    if pick < 0.8:
        return [grown(rng, depth - 1) for _ in range(rng.randint(1, 3))]
    return {rng.choice("abcdefgh") + str(i): grown(rng, depth - 1) for i in range(rng.randint(1, 3))}


def test_equals_a_recursion(spark):
    rng = random.Random(4)
    values = [grown(rng, 6) for _ in range(80)]
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)]
    got = sorted((r.id, r.path, r.kind, None if r.kind in ("model", "dataclass", "result") else json.dumps(json.loads(r.value)) if r.kind == "plain" else r.value, r.damaged) for r in tagged.nested(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect())
    want = sorted((i, p, k, json.dumps(v) if k == "plain" else v, d) for i, v in enumerate(values) for p, k, v, d in walk(v))
    assert got == want and {"datetime", "date", "time", "model", "result"} <= {w[2] for w in want} and any(w[4] for w in want)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, "null"), (5, " [ ] "), (None, "1"), (6, '"s"'), (6, '"s"')]
    got = sorted(map(tuple, tagged.nested(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()), key=str)
    assert got == sorted([(2, "$", None, None, True), (3, "$", None, None, True), (4, "$", "plain", "null", False), (5, "$", "plain", " [ ] ", False), (None, "$", "plain", "1", False), *[(6, "$", "plain", '"s"', False)] * 2], key=str)
    assert tagged.nested(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0
