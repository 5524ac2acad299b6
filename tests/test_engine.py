"""Completion through trees, enqueueing with feedback, children by definition, and what propagation reads."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from queuelens import schemas
from queuelens.functions import results
from queuelens.operators import dag, engine
from queuelens.sources import shared
from queuelens.sources.tables import T

NTZ = T.TimestampNTZType()
def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")

OK, ERR = '{"__task_result__":true,"ok":1,"err":null}', '{"__task_result__":true,"ok":null,"err":{"__task_error__":true,"error_code":"E","data":null,"message":"no"}}'


def flows(spark, *rows):
    """(id, parent, index, depth, root, on_error)"""
    df = spark.createDataFrame([(i, i, p, x, d, r, e, "RUNNING") for i, p, x, d, r, e in rows], "id string, name string, parent_workflow_id string, parent_task_index int, depth int, root_workflow_id string, on_error string, status string")
    return schemas.complete(df, schemas.WORKFLOWS, NTZ)


def nodes(spark, *rows):
    """(flow, index, dependencies, status, sub, more)"""
    base = {"join_type": "all", "min_success": None, "allow_failed_deps": False, "task_kwargs": None, "task_options": None, "sub_definition_key": None, "workflow_ctx_from": None, "result": None}
    out = []
    for flow, i, deps, status, sub, more in rows:
        x = base | more
        out.append((f"{flow}/{i}", flow, i, f"n{i}", f"fn{i}", deps, status, sub, None if sub else f"t-{flow}-{i}", *(x[k] for k in base)))
    kinds = "join_type string, min_success int, allow_failed_deps boolean, task_kwargs string, task_options string, sub_definition_key string, workflow_ctx_from array<string>, result string"
    df = spark.createDataFrame(out, "id string, workflow_id string, task_index int, node_id string, task_name string, dependencies array<int>, status string, is_subworkflow boolean, task_id string, " + kinds)
    return schemas.complete(df, schemas.WORKFLOW_TASKS, NTZ)


def ended(spark, *rows):
    return spark.createDataFrame([(t, ok, OK if ok else ERR) for t, ok in rows], "task_id string, ok boolean, result string")


def test_ends_climb_to_the_root(spark):
    """Five levels; the last node fails or not, and all above end with it."""
    chain = [("w0", None, None, 0, "w0", "fail"), *[(f"w{d}", f"w{d - 1}", 0, d, "w0", "fail") for d in range(1, 5)]]
    own = [(f"w{d}", 0, [], "RUNNING", d < 4, {}) for d in range(5)]
    for ok in (True, False):
        f, n, tasks = engine.complete_tree(flows(spark, *chain), nodes(spark, *own), ended(spark, ("t-w4-0", ok)), now())
        assert {r.status for r in f.collect()} == {"COMPLETED" if ok else "FAILED"} and tasks.count() == 0
        found = {r.workflow_id: r for r in n.collect()}
        assert {r.status for r in found.values()} == {"COMPLETED" if ok else "FAILED"}
        root = json.loads(found["w0"].sub_workflow_summary)
        assert (root["total_tasks"], root["completed_tasks"], root["failed_tasks"]) == (1, int(ok), int(not ok))
        if not ok:
            assert json.loads(found["w0"].result)["err"]["sub_workflow_id"] == "w1"


def test_a_paused_workflow_takes_the_result_and_stops(spark):
    f = flows(spark, ("p", None, None, 0, "p", "pause"), ("c", "p", 0, 1, "p", "fail"))
    n = nodes(spark, ("p", 0, [], "RUNNING", True, {}), ("p", 1, [0], "PENDING", False, {"allow_failed_deps": True}), ("c", 0, [], "RUNNING", False, {}))
    f, n, tasks = engine.complete_tree(f, n, ended(spark, ("t-c-0", False)), now())
    assert {r.id: r.status for r in f.collect()} == {"p": "PAUSED", "c": "FAILED"}
    assert {r.id: r.status for r in n.collect()} == {"p/0": "FAILED", "p/1": "PENDING", "c/0": "FAILED"} and tasks.count() == 0


def test_nodes_that_cannot_be_built_open_new_verdicts(spark):
    f = flows(spark, ("w", None, None, 0, "w", "fail"))
    n = nodes(
        spark, ("w", 0, [], "RUNNING", False, {}), ("w", 1, [0], "PENDING", False, {"task_options": "[1]"}), ("w", 2, [1], "PENDING", False, {"allow_failed_deps": True, "task_kwargs": "{bad"}),
        ("w", 3, [2], "PENDING", False, {}), ("w", 4, [2], "PENDING", False, {"allow_failed_deps": True, "workflow_ctx_from": ["n0", "n2"]}), ("w", 5, [0], "READY", False, {}),
    )
    f, n, tasks = engine.complete_tree(f, n, ended(spark, ("t-w-0", True)), now())
    found = {r.task_index: r for r in n.collect()}
    assert [found[i].status for i in range(6)] == ["COMPLETED", "FAILED", "FAILED", "SKIPPED", "ENQUEUED", "READY"]
    assert json.loads(found[1].result)["err"]["message"] == "Invalid task_options payload for task 1: expected object"
    made = {r.id: json.loads(r.kwargs) for r in tasks.collect()}
    assert set(made) == {"w/4"} and set(made["w/4"]["__workflow_ctx__"]["results_by_id"]) == {"n0", "n2"}
    assert json.loads(f.first().error)["message"].startswith("Corrupt kwargs JSON for task 2")


def test_children_start_by_their_definition(spark):
    f = flows(spark, ("w", None, None, 0, "w", "fail"))
    n = nodes(spark, ("w", 0, [], "RUNNING", False, {}), ("w", 1, [0], "PENDING", True, {"sub_definition_key": "d"}), ("w", 2, [0], "PENDING", True, {"sub_definition_key": "lost"}), ("w", 3, [2], "PENDING", False, {}))
    below = nodes(spark, ("x", 0, [], "READY", False, {}), ("x", 1, [0], "PENDING", False, {}), ("x", 2, [], "READY", True, {"sub_definition_key": "e"})).drop("workflow_id", "id", "status", "task_id").withColumn("definition_key", F.lit("d"))
    leaf = nodes(spark, ("x", 0, [], "READY", False, {"task_kwargs": "{bad"})).drop("workflow_id", "id", "status", "task_id").withColumn("definition_key", F.lit("e"))
    kinds = spark.createDataFrame([("d", "child", "fail"), ("e", "leaf", "fail")], "definition_key string, name string, on_error string")
    f, n, tasks = engine.complete_tree(f, n, ended(spark, ("t-w-0", True)), now(), engine.Definitions(kinds, below.unionByName(leaf)))
    # The leaf's only node can't be built: it fails, and so does the node above it.
    assert {r.id: (r.status, r.depth) for r in f.collect()} == {"w": ("RUNNING", 0), "w/1": ("RUNNING", 1), "w/1/2": ("FAILED", 2)}
    assert {r.id: r.status for r in n.collect()} == {"w/0": "COMPLETED", "w/1": "RUNNING", "w/2": "FAILED", "w/3": "SKIPPED", "w/1/0": "ENQUEUED", "w/1/1": "PENDING", "w/1/2": "FAILED", "w/1/2/0": "FAILED"}
    assert [r.id for r in tasks.collect()] == ["w/1/0"]
    assert "SUBWORKFLOW_LOAD_FAILED" in {r.id: r.result for r in n.collect()}["w/2"]


def test_definitions_that_contain_themselves_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(engine, "DEEPEST", 3)
    f = flows(spark, ("w", None, None, 0, "w", "fail"))
    n = nodes(spark, ("w", 0, [], "RUNNING", False, {}), ("w", 1, [0], "PENDING", True, {"sub_definition_key": "d"}))
    below = nodes(spark, ("x", 0, [], "READY", True, {"sub_definition_key": "d"})).drop("workflow_id", "id", "status", "task_id").withColumn("definition_key", F.lit("d"))
    kinds = spark.createDataFrame([("d", "child", "fail")], "definition_key string, name string, on_error string")
    with pytest.raises(ValueError, match="contain themselves"):
        engine.complete_tree(f, n, ended(spark, ("t-w-0", True)), now(), engine.Definitions(kinds, below))


def test_nothing_ends(spark):
    f, n = flows(spark, ("w", None, None, 0, "w", "fail")), nodes(spark, ("w", 0, [], "RUNNING", False, {}))
    out = engine.complete_tree(f, n, ended(spark, ("unknown", True)), now())
    assert [r.status for r in out[0].collect()] == ["RUNNING"] and [r.status for r in out[1].collect()] == ["RUNNING"] and out[2].count() == 0
    out = engine.complete_tree(f.limit(0), n.limit(0), ended(spark, ("unknown", True)), now())
    assert [x.count() for x in out] == [0, 0, 0]


def test_later_rounds_read_only_where_something_was_skipped(spark):
    long = [("a", 0, [], "FAILED", False, {}), *[("a", i, [i - 1], "PENDING", False, {}) for i in range(1, 5)]]
    wide = [("b", 0, [], "RUNNING", False, {}), *[("b", i, [0], "PENDING", False, {}) for i in range(1, 50)]]
    f = flows(spark, *[(w, None, None, 0, w, "fail") for w in "ab"])
    sizes: list[int] = []
    out = dag.propagate(nodes(spark, *long, *wide), f, sizes)
    assert sizes == [53, 3, 2, 1, 0] and out.filter("status = 'SKIPPED'").count() == 4


def test_what_can_be_read_of_results(spark):
    texts = ['{"ok":1}', '{"err":{"error_code":"X","data":[1.50],"exception":{"t":1}}}', '{"err":"x"}', '{"r":1}', '{"ok', "null", "", None, '{"__task_result__":true,"ok":{"é":"\\n"},"err":null}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.expr(results.canonical("t")).alias("c"), F.expr(results.error_of("t")).alias("e"), F.expr(results.text("t")).alias("q"))
    rows = df.collect()
    tag = '{"__task_result__":true,'
    err = '{"__task_error__":true,"error_code":"X","data":[1.5],"message":null,"exception":{"t":1}}'
    assert [r.c for r in rows] == [tag + '"ok":1,"err":null}', tag + f'"ok":null,"err":{err}}}', None, None, None, None, None, None, tag + '"ok":{"é":"\\n"},"err":null}']
    assert [r.e for r in rows] == [None, err, *[None] * 7]
    assert [json.loads(r.q) for r in rows] == texts


def test_workflows_without_a_depth_stay_as_they_are(spark):
    f = flows(spark, ("w", None, None, 0, "w", "fail"), ("x", "w", 0, None, "w", "fail"), ("y", None, None, None, "y", "fail"))
    n = nodes(spark, ("w", 0, [], "RUNNING", False, {}), ("x", 0, [], "RUNNING", False, {}), ("y", 0, [], "RUNNING", False, {}))
    f, n, _ = engine.complete_tree(f, n, ended(spark, ("t-w-0", True), ("t-y-0", True)), now())
    assert {r.id: r.status for r in f.collect()} == {"w": "COMPLETED", "x": "RUNNING", "y": "RUNNING"}
    assert {r.id: r.status for r in n.collect()} == {"w/0": "COMPLETED", "x/0": "RUNNING", "y/0": "RUNNING"}


def test_only_nodes_that_start_are_joined_and_written_again(spark, monkeypatch):
    sizes, write = {}, engine.written

    def counted(df, name):
        out = write(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(engine, "written", counted)
    idle = [("w", i, [0], "RUNNING", False, {}) for i in range(2, 10)]
    f = flows(spark, ("w", None, None, 0, "w", "fail"))
    n = nodes(spark, ("w", 0, [], "RUNNING", False, {}), ("w", 1, [0], "PENDING", False, {}), *idle)
    f, n, tasks = engine.complete_tree(f, n, ended(spark, ("t-w-0", True)), now())
    assert {r.id: r.status for r in n.collect()} == {"w/0": "COMPLETED", "w/1": "ENQUEUED"} | {f"w/{i}": "RUNNING" for i in range(2, 10)}
    assert [r.id for r in tasks.collect()] == ["w/1"]
    # All of them, all with the event, and the one that starts.
    assert sizes["engine-nodes"] == [10, 10, 1] and sizes["engine-ready"] == [10]


def test_results_are_read_without_joins(spark):
    """Joins of all levels in the returned plan would broadcast the ids of all workflows through the driver at once."""
    chain = [("w0", None, None, 0, "w0", "fail"), ("w1", "w0", 0, 1, "w0", "fail"), ("w2", "w1", 0, 2, "w0", "fail"), ("x", None, None, 0, "x", "fail")]
    own = [("w0", 0, [], "RUNNING", True, {}), ("w1", 0, [], "RUNNING", True, {}), ("w2", 0, [], "RUNNING", False, {}), ("x", 0, [], "RUNNING", False, {})]
    f, n, tasks = engine.complete_tree(flows(spark, *chain), nodes(spark, *own), ended(spark, ("t-w2-0", True)), now())
    for df in (f, n, tasks):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.status for r in f.collect()} == {"w0": "COMPLETED", "w1": "COMPLETED", "w2": "COMPLETED", "x": "RUNNING"}
    assert {r.workflow_id: r.status for r in n.collect()} == {"w0": "COMPLETED", "w1": "COMPLETED", "w2": "COMPLETED", "x": "RUNNING"}


def test_broadcasts_are_bounded_by_what_is_measured(spark):
    """300,000 ids are a small share of the files of a wide table, and much more in memory."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    wide = shared.written(spark.range(300_000).select(F.concat(F.lit("tw-"), "id").alias("id"), *[F.lit(None).cast("string").alias(f"c{i}") for i in range(30)]), "wide")
    joined = spark.range(300_000).select(F.concat(F.lit("tw-"), "id").alias("id")).join(wide.select("id"), "id", "left_semi")
    plan = lambda: joined.select("*")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan()
    with shared.measured_broadcasts(spark):
        assert "BroadcastHashJoin" not in plan()
        assert joined.count() == 300_000
        assert "BroadcastHashJoin" in spark.range(9).join(spark.range(9), "id")._jdf.queryExecution().sparkPlan().toString()
    assert [spark.conf.get(k, None) for k in keys] == before
    shared.clear(spark)
