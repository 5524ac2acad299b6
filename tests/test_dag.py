"""Join types, their cascades, and checks of graphs, against a plain simulation."""

from __future__ import annotations

import random

from queuelens.operators import dag as D

SCHEMA = "id string, workflow_id string, task_index int, node_id string, dependencies array<int>, join_type string, min_success int, allow_failed_deps boolean, status string, workflow_ctx_from array<string>"


def flows(spark, n=1):
    return spark.createDataFrame([(f"w{i}", "RUNNING") for i in range(n)], "id string, status string")


def node(i, deps=(), join="all", status="PENDING", need=None, allow=False, ctx=(), flow="w0"):
    return (f"{flow}-{i}", flow, i, f"n{i}", list(deps), join, need, allow, status, list(ctx))


def final(spark, *nodes):
    df = spark.createDataFrame(list(nodes), SCHEMA)
    return {r.task_index: r.status for r in D.propagate(df, flows(spark)).collect()}


def test_all_waits_and_skips(spark):
    assert final(spark, node(0, status="COMPLETED"), node(1, status="RUNNING"), node(2, [0, 1]))[2] == "PENDING"
    got = final(spark, node(0, status="COMPLETED"), node(1, status="FAILED"), node(2, [0, 1]), node(3, [2]), node(4, [0, 1], allow=True))
    assert (got[2], got[3], got[4]) == ("SKIPPED", "SKIPPED", "READY")


def test_any(spark):
    got = final(spark, node(0, status="COMPLETED"), node(1, status="RUNNING"), node(2, [0, 1], "any"), node(3, [1], "any"))
    assert (got[2], got[3]) == ("READY", "PENDING")
    got = final(spark, node(0, status="FAILED"), node(1, status="SKIPPED"), node(2, [0, 1], "any"), node(3, [2]))
    assert (got[2], got[3]) == ("SKIPPED", "SKIPPED")


def test_quorum(spark):
    done = [node(0, status="COMPLETED"), node(1, status="FAILED"), node(2, status="RUNNING")]
    got = final(spark, *done, node(3, [0, 1, 2], "quorum", need=2), node(4, [0, 1, 2], "quorum", need=3), node(5, [0, 1], "quorum", need=1))
    assert (got[3], got[4], got[5]) == ("PENDING", "SKIPPED", "READY")


def test_context_gate_comes_before_failed_dependencies(spark):
    got = final(spark, node(0, status="FAILED"), node(1, status="RUNNING"), node(2, [0], ctx=["n1"]), node(3, [0]))
    assert (got[2], got[3]) == ("PENDING", "SKIPPED")


def test_random_graphs_equal_a_simulation(spark):
    rng = random.Random(5)
    nodes = []
    for w in range(40):
        for i in range(8):
            deps = sorted(rng.sample(range(i), min(i, rng.randint(0, 3))))
            status = rng.choice(["COMPLETED", "FAILED", "SKIPPED", "RUNNING"]) if not deps else "PENDING"
            nodes.append(node(i, deps, rng.choice(["all", "any", "quorum"]), status, rng.randint(1, 3), rng.random() < 0.3, flow=f"w{w}"))

    def settle(own):
        state = {n[2]: n[8] for n in own}
        while True:
            new = dict(state)
            for _, _, i, _, deps, join, need, allow, _, _ in own:
                if state[i] != "PENDING" or not deps:
                    continue
                c, f, s = (sum(state[d] == x for d in deps) for x in ("COMPLETED", "FAILED", "SKIPPED"))
                t = c + f + s
                if join == "any":
                    new[i] = "READY" if c else "SKIPPED" if t == len(deps) else "PENDING"
                elif join == "quorum":
                    new[i] = "SKIPPED" if c + len(deps) - t < need else "READY" if c >= need else "PENDING"
                elif t == len(deps):
                    new[i] = "SKIPPED" if f + s and not allow else "READY"
            if new == state:
                return state
            state = new

    expected = {}
    for w in range(40):
        own = [n for n in nodes if n[1] == f"w{w}"]
        expected |= {(f"w{w}", i): s for i, s in settle(own).items()}
    got = {(r.workflow_id, r.task_index): r.status for r in D.propagate(spark.createDataFrame(nodes, SCHEMA), flows(spark, 40)).collect()}
    assert got == expected


def test_invalid_graphs(spark):
    df = spark.createDataFrame([node(0, [1], flow="cycle"), node(1, [0], flow="cycle"), node(2, flow="cycle"), node(0, flow="fine"), node(1, [0], flow="fine"), node(0, flow="lost"), node(1, [7], flow="lost")], SCHEMA)
    assert {tuple(r) for r in D.invalid_graphs(df).collect()} == {("cycle", "cycle"), ("lost", "unknown dependency")}


def test_only_graphs_with_an_edge_up_are_peeled(spark, monkeypatch):
    """A long chain towards smaller indices costs no round of peeling; a cycle behind a chain is found."""
    from queuelens.operators import dag

    chain = [node(0, flow="chain"), *[node(i, [i - 1], flow="chain") for i in range(1, 12)]]
    cycle = [node(0, flow="cycle"), node(1, [0, 3], flow="cycle"), node(2, [1], flow="cycle"), node(3, [2], flow="cycle"), node(4, [3], flow="cycle")]
    sizes, real = [], dag.written
    monkeypatch.setattr(dag, "written", lambda df, name: sizes.append(df.count()) or real(df, name))
    assert {tuple(r) for r in D.cycles(spark.createDataFrame(chain + cycle, SCHEMA)).collect()} == {("cycle", "cycle")}
    assert sizes[0] == 5
    sizes.clear()
    assert not D.cycles(spark.createDataFrame(chain, SCHEMA)).collect() and sizes == [0]
