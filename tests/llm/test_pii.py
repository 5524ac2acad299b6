"""Long texts, and edge cases of spans."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from queuelens.llm import pii


def brute(text):
    found = [(k, m.start(), m.end()) for k, p in pii.BASE.items() for m in re.finditer(p, text) if pii.valid(k, m[0])]
    return pii.ordered(found)


@pytest.mark.parametrize("unit", ["1", "a", "one two three four five six seven eight nine. And ", "a@", " at ", "1.", "1 dot 2 dot 3 dot 4 x ", "bob at mail dot com ", "+1 ", "[", "а", " dot", "a dot b at ", "( "])
def test_long_texts_take_linear_time(unit):
    text = unit * (300_000 // len(unit))
    began = time.process_time()
    pii.spans(text, True, True)
    assert time.process_time() - began < 8


def test_base_spans_of_random_texts():
    rng = random.Random(9)
    parts = ["a", "x.y", "@", ".", "1", "22", "255", "0256", "4111111111111111", "+", "-", " ", "(", ")", "é", "\n", "192.168.0.1", "+44 20 7946 0958"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert pii.plain_spans(text) == brute(text)


def test_very_long_numbers_are_no_addresses():
    assert pii.plain_spans("0" * 6000 + "1.2.3.4") == [("ip", 0, 6007)] and pii.plain_spans("1" * 6000 + ".2.3.4") == []


def test_edge_rows(spark):
    mail = "write to bob@mail.example.com or 10.0.0.1"
    rows = [(1, mail), (2, None), (3, ""), (1, mail), (None, mail), (4, "x" * 4_000 + " " + mail)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("pii", "redacted", "kind", "start")})
    got = pii.find(df).select("doc_id", "text", "redacted", "kind", pii.joined(F.col("pii_base")).alias("base")).collect()
    assert len(got) == 6
    for r in got:
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(r.text or "")) and r.kind == 7
        assert r.redacted == (r.text or "").replace("bob@mail.example.com", "[EMAIL]").replace("10.0.0.1", "[IP]")
