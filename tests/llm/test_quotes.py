"""Quotation linking against its SQL oracle on random conversations with quotes, and on a long one."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from queuelens.llm import quotes
from queuelens.llm.op4_quotes import ORACLE

WORDS = "yes no the a plan works well today maybe later".split()


def conversations(seed: int) -> list[tuple]:
    """Messages that quote whole texts, parts, paragraphs, edited and nested passages of their own and other conversations."""
    rng = random.Random(seed)
    said: list[tuple[int, int, str]] = []
    rows = []
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4)))
    for _ in range(60):
        conv, turn = rng.randrange(4), rng.randrange(14)
        own = [line() if rng.random() < 0.85 else "" for _ in range(rng.randrange(1, 9))]
        parts = []
        for _ in range(rng.randrange(3) if said else 0):
            source = rng.choice(said)[2].split("\n")
            a = rng.randrange(len(source))
            cut = source[a : a + rng.randrange(1, 8)]
            kind = rng.random()
            if kind < 0.2:
                cut = [" ".join(cut)]  # wrapped anew
            elif kind < 0.35:
                cut = [*cut, "edited"]
            elif kind < 0.5:
                cut = [c.upper() + "  " for c in cut]
            parts += [">" * rng.choice((1, 1, 2, 3)) + " " + c for c in cut]
        text = "\n".join([*parts, *own] if rng.random() < 0.7 else [*own, *parts])
        said.append((conv, turn, text))
        rows.append((conv if rng.random() < 0.97 else None, turn if rng.random() < 0.97 else None, rng.choice(("user", "assistant")), text if rng.random() < 0.97 else None))
    return rows + rows[:3]


@pytest.mark.parametrize("seed", range(3))
def test_equals_oracle(spark, seed):
    rows = conversations(seed)
    found = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    con = duckdb.connect()
    con.register("raw", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    con.execute("create table conversations as select cast(conv_id as bigint) as conv_id, cast(turn as bigint) as turn, role, text from raw")
    result = con.execute(ORACLE)
    names = [d[0] for d in result.description]
    assert sorted((tuple(r[n] for n in names) for r in found), key=repr) == sorted(result.fetchall(), key=repr)
    assert sum(r.n_linked for r in found) > 20


def test_parts_of_messages(spark):
    original = "one\ntwo\nthree\nfour\nfive\n\nsix seven\neight"
    quotes_ = ["> two\n> three\n> four", "> SIX  seven eight", "> three\n> two", "> one\n>\n> two", ">> five\n>> six seven\n> ok", "> two\n> three\n> four\n> five\n> six seven\n> eight"]
    rows = [(1, 0, "user", original), *[(1, i + 1, "user", q + "\nreply") for i, q in enumerate(quotes_)]]
    found = {r.turn: r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [found[i + 1].n_linked for i in range(6)] == [1, 1, 0, 1, 1, 1]
    assert [found[i + 1].reply_to for i in range(6)] == [0, 0, 2, 0, 0, 0]


def test_long_conversation_with_a_repeated_line(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "'user' as role", "case when id % 2 = 0 then 'ok\nmessage ' || id else '> ok\nmessage ' || id end as text")
    found = quotes.conversations(rows)
    row = found.agg({"n_linked": "sum", "depth": "max"}).first()
    assert row["sum(n_linked)"] == n // 2 and row["max(depth)"] > 0
    assert found.filter("turn % 2 = 1 and reply_to <> turn - 1").count() == 0
