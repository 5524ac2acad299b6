"""Workflow graphs: edges, readiness, results, success, recovery."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions import results
from queuelens.functions.tagged import RESULT
from queuelens.schemas import NODE_TERMINAL, POLICY, TASK_TERMINAL, WORKFLOW_TERMINAL
from queuelens.sources.shared import written


def ended(status: str = "status") -> Column:
    return F.col(status).isin(*NODE_TERMINAL)


def edges(nodes: DataFrame) -> DataFrame:
    """(workflow_id, task_index, dep): one row for each entry of a node's dependencies."""
    return nodes.select("workflow_id", "task_index", F.explode("dependencies").alias("dep"))


def dep_status_counts(nodes: DataFrame, edge: DataFrame | None = None) -> DataFrame:
    """(workflow_id, task_index, completed, failed, skipped) over the nodes that a node depends on.

    A dependency that is listed twice counts once, as it names one node.
    """
    edge = (edges(nodes) if edge is None else edge).distinct()
    state = nodes.select("workflow_id", F.col("task_index").alias("dep"), F.col("status").alias("dep_status"))
    joined = edge.join(state, ["workflow_id", "dep"])
    count = lambda s: F.count_if(F.col("dep_status") == s.upper()).alias(s)
    return joined.groupBy("workflow_id", "task_index").agg(count("completed"), count("failed"), count("skipped"))


def ctx_ready(nodes: DataFrame) -> DataFrame:
    """(workflow_id, task_index, ctx_ready): whether all nodes of a node's context have ended."""
    wanted = nodes.filter(F.size("workflow_ctx_from") > 0).select("workflow_id", "task_index", F.size(F.array_distinct("workflow_ctx_from")).alias("wanted"), F.explode(F.array_distinct("workflow_ctx_from")).alias("node_id"))
    done = nodes.filter(ended()).select("workflow_id", "node_id", F.lit(1).alias("done"))
    met = wanted.join(done, ["workflow_id", "node_id"], "left").groupBy("workflow_id", "task_index").agg(F.count("done").alias("done"), F.first("wanted").alias("wanted"))
    return met.select("workflow_id", "task_index", (F.col("done") >= F.col("wanted")).alias("ctx_ready"))


def _live(workflows: DataFrame) -> DataFrame:
    return workflows.filter("status = 'RUNNING'").select(F.col("id").alias("workflow_id"))


def counters(nodes: DataFrame, workflows: DataFrame) -> DataFrame:
    """PENDING nodes with dependencies in running workflows, with what their verdict follows from.

    `completed`, `failed` and `skipped` count dependencies, `lacking` the nodes
    of the context that have not ended.
    """
    waiting = nodes.filter((F.col("status") == "PENDING") & (F.size("dependencies") > 0)).join(_live(workflows), "workflow_id", "left_semi")
    context = F.col("workflow_ctx_from") if "workflow_ctx_from" in nodes.columns else F.lit(None).cast("array<string>")
    config = waiting.select("workflow_id", "task_index", "node_id" if "node_id" in nodes.columns else F.lit(None).cast("string").alias("node_id"), "dependencies", context.alias("workflow_ctx_from"), "join_type", "min_success", "allow_failed_deps")
    counted = config.join(dep_status_counts(nodes, edges(waiting)), ["workflow_id", "task_index"], "left")
    if "workflow_ctx_from" in nodes.columns:
        wanted = waiting.select("workflow_id", "task_index", F.explode(F.array_distinct("workflow_ctx_from")).alias("node_id"))
        done = nodes.filter(ended()).select("workflow_id", "node_id", F.lit(1).alias("done"))
        lack = wanted.join(done, ["workflow_id", "node_id"], "left").groupBy("workflow_id", "task_index").agg(F.count_if(F.col("done").isNull()).alias("lacking"))
        counted = counted.join(lack, ["workflow_id", "task_index"], "left")
    else:
        counted = counted.withColumn("lacking", F.lit(0))
    return counted.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("completed", "failed", "skipped", "lacking")})


def verdict() -> Column:
    """READY, SKIPPED or PENDING from `counters`, by join type.

    First whether the node can still run, then its context, then whether it may
    run now, then, for "all", whether failed dependencies are allowed.
    """
    c, f, s = F.col("completed"), F.col("failed"), F.col("skipped")
    size, t = F.size("dependencies"), c + f + s
    need = F.greatest(F.coalesce("min_success", F.lit(1)), F.lit(1))
    kind = F.col("join_type")
    lost = ((kind == "any") & (t == size) & (c == 0)) | ((kind == "quorum") & (c + (size - t) < need))
    open_ = ((kind == "all") & (t == size)) | ((kind == "any") & (c >= 1)) | ((kind == "quorum") & (c >= need))
    spoiled = (kind == "all") & (f + s > 0) & ~F.coalesce("allow_failed_deps", F.lit(False))
    return F.when(lost, "SKIPPED").when(F.col("lacking") > 0, "PENDING").when(open_ & spoiled, "SKIPPED").when(open_, "READY").otherwise("PENDING")


def verdicts(nodes: DataFrame, workflows: DataFrame) -> DataFrame:
    """(workflow_id, task_index, verdict) of PENDING nodes with dependencies in running workflows."""
    return counters(nodes, workflows).select("workflow_id", "task_index", verdict().alias("verdict"))


def settled(nodes: DataFrame, workflows: DataFrame, sizes: list | None = None) -> DataFrame:
    """(workflow_id, task_index, verdict): READY or SKIPPED, after all that skipped nodes lead to.

    The first round counts the dependencies of all waiting nodes. Only skips
    open new verdicts, so a later round reads only the nodes that still wait in
    workflows with a new skip, and adds to their counters what the new skips
    are to them. `sizes` gets how many nodes each round has read. There are at
    most as many rounds as the longest path has nodes.
    """
    state = written(counters(nodes, workflows).withColumn("verdict", verdict()), "dag-counters")
    found = []
    while True:
        found.append(state.filter("verdict <> 'PENDING'").select("workflow_id", "task_index", "verdict"))
        read, skips = state.agg(F.count("*"), F.count_if(F.col("verdict") == "SKIPPED")).first()
        if sizes is not None:
            sizes.append(read)
        if not skips:
            return functools.reduce(DataFrame.unionByName, found)
        skipped = state.filter("verdict = 'SKIPPED'")
        waiting = state.filter("verdict = 'PENDING'").drop("verdict").join(skipped.select("workflow_id").distinct(), "workflow_id", "left_semi")
        met = edges(waiting).distinct().join(skipped.select("workflow_id", F.col("task_index").alias("dep")), ["workflow_id", "dep"]).groupBy("workflow_id", "task_index").agg(F.count("*").alias("_skipped"))
        seen = waiting.select("workflow_id", "task_index", F.explode(F.array_distinct("workflow_ctx_from")).alias("node_id")).join(skipped.select("workflow_id", "node_id"), ["workflow_id", "node_id"]).groupBy("workflow_id", "task_index").agg(F.count("*").alias("_seen"))
        more = waiting.join(met, ["workflow_id", "task_index"], "left").join(seen, ["workflow_id", "task_index"], "left")
        more = more.withColumns({"skipped": F.col("skipped") + F.coalesce("_skipped", F.lit(0)), "lacking": F.col("lacking") - F.coalesce("_seen", F.lit(0))}).drop("_skipped", "_seen")
        state = written(more.withColumn("verdict", verdict()), "dag-counters")


def propagate(nodes: DataFrame, workflows: DataFrame, sizes: list | None = None) -> DataFrame:
    """Nodes after all verdicts, and what skipped nodes lead to, have taken effect. See `settled`."""
    return _with(nodes, settled(nodes, workflows, sizes))


def _with(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    seen = nodes.join(moved, ["workflow_id", "task_index"], "left")
    return seen.withColumn("status", F.coalesce("verdict", "status")).select(nodes.columns)


def waiting(nodes: DataFrame) -> DataFrame:
    """(workflow_id, task_index, dependencies) of PENDING nodes."""
    return nodes.filter("status = 'PENDING'").select("workflow_id", "task_index", "dependencies")


def ready(nodes: DataFrame) -> DataFrame:
    """(workflow_id, task_index, dependencies, is_subworkflow) of READY nodes."""
    return nodes.filter("status = 'READY'").select("workflow_id", "task_index", "dependencies", "is_subworkflow")


def sinks(nodes: DataFrame) -> DataFrame:
    """Nodes that no other node depends on."""
    used = edges(nodes).select("workflow_id", F.col("dep").alias("task_index"))
    return nodes.join(used, ["workflow_id", "task_index"], "left_anti").select("workflow_id", "task_index", "node_id", "result")


def dependents(nodes: DataFrame, completed: DataFrame) -> DataFrame:
    """PENDING nodes that depend on one of `completed` (workflow_id, task_index)."""
    done = completed.select("workflow_id", F.col("task_index").alias("dep"))
    return edges(nodes.filter("status = 'PENDING'")).join(done, ["workflow_id", "dep"]).select("workflow_id", "task_index").distinct()


def ended_value() -> Column:
    """What an ended node's result is to others (see `results.seen_by_others`)."""
    return F.expr(results.seen_by_others())


def told() -> Column:
    """Whether a node has ended with something to tell others: with a result, or skipped."""
    return ended() & ((F.col("status") == "SKIPPED") | (F.coalesce("result", F.lit("")) != ""))


def dependency_results(nodes: DataFrame) -> DataFrame:
    """(workflow_id, task_index, results): a map from dependency to the result of those that have ended with one."""
    done = nodes.filter(told()).select("workflow_id", F.col("task_index").alias("dep"), ended_value().alias("value"))
    entry = F.struct("dep", "value")
    return edges(nodes).distinct().join(done, ["workflow_id", "dep"]).groupBy("workflow_id", "task_index").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("results"))


def child_summary(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Child workflows with counts of their nodes, for the parent's node; one aggregate for all of them.

    `result` and `error` are those of the child, if the table has them.
    """
    children = workflows.filter("parent_workflow_id is not null")
    counts = nodes.groupBy("workflow_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s.upper()).alias(s) for s in ("completed", "failed", "skipped")])
    seen = children.join(counts, F.col("id") == F.col("workflow_id"), "left")
    zero = F.lit(0).cast("long")
    own = [workflows[c] if c in workflows.columns else F.lit(None).cast("string").alias(c) for c in ("result", "error")]
    return seen.select("id", "parent_workflow_id", "parent_task_index", workflows["status"], *[F.coalesce(c, zero).alias(c) for c in ("total", "completed", "failed", "skipped")], *own)


def completion_status(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Open, failed, completed and all nodes of each workflow; a workflow without nodes has a total of 1."""
    counts = nodes.groupBy("workflow_id").agg(F.count_if(~ended()).alias("incomplete"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count("*").alias("total"))
    seen = workflows.join(counts, F.col("id") == F.col("workflow_id"), "left")
    fill = {"incomplete": 0, "failed": 0, "completed": 0, "total": 1}
    return seen.select("id", workflows["status"], "completed_at", *[F.coalesce(c, F.lit(n).cast("long")).alias(c) for c, n in fill.items()])


def _required(workflows: DataFrame) -> DataFrame:
    """(id, case_no, task_index): what each case of a workflow's success policy requires."""
    cases = F.from_json("success_policy", POLICY)["cases"]
    each = workflows.filter("success_policy is not null").select("id", F.posexplode(cases).alias("case_no", "case"))
    return each.select("id", "case_no", F.explode(F.array_distinct("case.required_indices")).alias("task_index"))


def _has_policy() -> Column:
    """A policy that is no JSON object counts as none."""
    return F.col("success_policy").isNotNull() & F.expr(results.is_object("success_policy"))


def success(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, failed, policy_met, succeeded).

    With a policy a workflow succeeds if all nodes of one of its non-empty
    cases are COMPLETED; without one if no node failed and no error is noted.
    """
    done = nodes.select(F.col("workflow_id").alias("id"), "task_index", (F.col("status") == "COMPLETED").alias("_done"))
    case = _required(workflows).join(done, ["id", "task_index"], "left").groupBy("id", "case_no").agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("_met"))
    met = case.groupBy("id").agg(F.bool_or("_met").alias("_met"))
    counts = nodes.groupBy(F.col("workflow_id").alias("id")).agg(F.count_if(F.col("status") == "FAILED").alias("failed"))
    seen = workflows.join(counts, "id", "left").join(met, "id", "left")
    no_error = F.col("error").isNull() if "error" in workflows.columns else F.lit(True)
    failed, met = F.coalesce("failed", F.lit(0).cast("long")), F.coalesce("_met", F.lit(False))
    return seen.select("id", failed.alias("failed"), F.when(_has_policy(), met).alias("policy_met"), F.when(_has_policy(), met).otherwise(no_error & (failed == 0)).alias("succeeded"))


def first_failed(nodes: DataFrame, workflows: DataFrame | None = None) -> DataFrame:
    """(workflow_id, task_index, result) of each workflow's first failed node; with workflows, of its required nodes."""
    failed = nodes.filter("status = 'FAILED'")
    if workflows is not None:
        required = _required(workflows).select(F.col("id").alias("workflow_id"), "task_index").distinct()
        failed = failed.join(required, ["workflow_id", "task_index"], "left_semi")
    return failed.groupBy("workflow_id").agg(F.min("task_index").alias("task_index"), F.min_by("result", "task_index").alias("result"))


def final_results(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, result): of the output node where one is named (`null` if it has none), else the value of all sinks by node.

    Workflows without any node have no result here. Sinks without an id are left out.
    """
    named = workflows.filter("output_task_index is not null").select("id", F.col("output_task_index").alias("task_index"))
    given = nodes.select(F.col("workflow_id").alias("id"), "task_index", F.nullif("result", F.lit("")).alias("result"))
    one = named.join(given, ["id", "task_index"], "left").select("id", F.coalesce("result", F.lit("null")).alias("result"))
    last = sinks(nodes).join(workflows.filter("output_task_index is null").select(F.col("id").alias("workflow_id")), "workflow_id", "left_semi")
    entry = F.when(F.col("node_id").isNotNull(), F.struct("node_id", F.coalesce(F.expr(results.canonical("result")), F.lit("null")).alias("value")))
    many = last.groupBy(F.col("workflow_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    members = f"concat('{{', array_join(transform(entries, e -> concat({results.text('e.node_id')}, ':', e.value)), ','), '}}')"
    value = F.expr(results.obj(**{RESULT: "'true'", "ok": members, "err": "'null'"}))
    return one.unionByName(many.select("id", value.alias("result")))


def completions(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, to) of running workflows whose nodes have all ended: COMPLETED or FAILED."""
    state = completion_status(workflows.filter("status = 'RUNNING' and completed_at is null"), nodes).filter("incomplete = 0")
    return state.select("id").join(success(workflows, nodes).select("id", "succeeded"), "id").select("id", F.when(F.col("succeeded"), "COMPLETED").otherwise("FAILED").alias("to"))


def on_error(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, to, error): running workflows with a failed node, which pause or go on with its error noted."""
    failed = first_failed(nodes).select(F.col("workflow_id").alias("id"), F.expr(results.error_of("result")).alias("error"))
    live = workflows.filter("status = 'RUNNING'").select("id", "on_error")
    return live.join(failed, "id").select("id", F.when(F.col("on_error") == "pause", "PAUSED").otherwise("RUNNING").alias("to"), "error")


# ---- recovery --------------------------------------------------------------


def _running(workflows: DataFrame) -> DataFrame:
    return workflows.filter("status = 'RUNNING'").select(F.col("id").alias("workflow_id"), "depth", "root_workflow_id")


def rec_pending(nodes: DataFrame, workflows: DataFrame) -> DataFrame:
    """PENDING nodes whose dependencies have all ended; nodes without any are among them."""
    waiting = nodes.filter("status = 'PENDING'").join(_running(workflows), "workflow_id")
    open_ = nodes.filter(~ended()).select("workflow_id", F.col("task_index").alias("dep"))
    held = edges(waiting).join(open_, ["workflow_id", "dep"], "left_semi").select("workflow_id", "task_index")
    return waiting.join(held, ["workflow_id", "task_index"], "left_anti").select("workflow_id", "task_index", "depth", "root_workflow_id")


def rec_ready(nodes: DataFrame, workflows: DataFrame, subworkflows: bool = False) -> DataFrame:
    """READY nodes that were never enqueued (no task), or whose child workflow was never started."""
    kind = F.col("is_subworkflow") if subworkflows else ~F.col("is_subworkflow")
    link = "sub_workflow_id" if subworkflows else "task_id"
    loose = F.col(link).isNull() if link in nodes.columns else F.lit(True)
    return nodes.filter((F.col("status") == "READY") & kind & loose).join(_running(workflows), "workflow_id").select("workflow_id", "task_index", "depth", "root_workflow_id")


def rec_children(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ended child workflows whose running parent's node still waits for them."""
    child = workflows.filter(F.col("status").isin(*WORKFLOW_TERMINAL) & F.col("parent_workflow_id").isNotNull()).select("id", F.col("parent_workflow_id").alias("workflow_id"), F.col("parent_task_index").alias("task_index"), "status")
    parent = workflows.filter("status = 'RUNNING'").select(F.col("id").alias("workflow_id"))
    waiting = nodes.filter("status = 'RUNNING'").select("workflow_id", "task_index")
    met = child.join(parent, "workflow_id", "left_semi").join(waiting, ["workflow_id", "task_index"])
    return met.select("id", F.col("workflow_id").alias("parent_workflow_id"), F.col("task_index").alias("parent_task_index"), "status")


def rec_crashed(nodes: DataFrame, tasks: DataFrame, workflows: DataFrame) -> DataFrame:
    """Open nodes of running workflows whose task has ended."""
    open_ = nodes.filter(~ended() & F.col("task_id").isNotNull() & ~F.col("is_subworkflow")).select("workflow_id", "task_index", "task_id")
    done = tasks.filter(F.upper("status").isin(*TASK_TERMINAL)).select(F.col("id").alias("task_id"), F.upper("status").alias("task_status"))
    return open_.join(_running(workflows), "workflow_id", "left_semi").join(done, "task_id").select("workflow_id", "task_index", "task_id", "task_status")


def rec_terminal(workflows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Running workflows without an open node, those without nodes included, and how many nodes failed."""
    done = completion_status(workflows.filter("status = 'RUNNING'"), nodes).filter("incomplete = 0")
    return done.select("id", F.col("failed").alias("failed_count"))


# ---- checks ----------------------------------------------------------------


def invalid_graphs(nodes: DataFrame, workflows: DataFrame | None = None) -> DataFrame:
    """(workflow_id, problem): no root, unknown dependency, impossible quorum, or a cycle; with workflows also a success
    policy or an output that names no node.

    Cycles are found by peeling: nodes all of whose dependencies are peeled go,
    level by level; what can't be peeled is on a cycle or behind one.
    """
    roots = nodes.filter(F.size("dependencies") == 0).select("workflow_id").distinct()
    no_root = nodes.select("workflow_id").distinct().join(roots, "workflow_id", "left_anti").select("workflow_id", F.lit("no root").alias("problem"))
    known = nodes.select("workflow_id", F.col("task_index").alias("dep"))
    unknown = edges(nodes).join(known, ["workflow_id", "dep"], "left_anti").select("workflow_id", F.lit("unknown dependency").alias("problem"))
    quorum = nodes.filter((F.col("join_type") == "quorum") & (F.col("min_success") > F.size("dependencies"))).select("workflow_id", F.lit("quorum over all dependencies").alias("problem"))
    found = no_root.unionByName(unknown).unionByName(quorum).unionByName(cycles(nodes))
    if workflows is not None:
        required = F.flatten(F.transform(F.from_json("success_policy", POLICY)["cases"], lambda c: c.required_indices))
        asked = workflows.select(F.col("id").alias("workflow_id"), F.explode(required).alias("dep"))
        found = found.unionByName(asked.join(known, ["workflow_id", "dep"], "left_anti").select("workflow_id", F.lit("policy over unknown nodes").alias("problem")))
        output = workflows.filter("output_task_index is not null").select(F.col("id").alias("workflow_id"), F.col("output_task_index").alias("dep"))
        found = found.unionByName(output.join(known, ["workflow_id", "dep"], "left_anti").select("workflow_id", F.lit("unknown output").alias("problem")))
    return found.distinct()


def nested_definitions(uses: DataFrame) -> DataFrame:
    """(name): definitions that contain themselves, by what they use, (name, uses): the closure of the few names, level by level."""
    pairs = uses.select("name", "uses").distinct()
    reach, count = pairs, 0
    while True:
        reach = written(reach, "dag-nested")
        now = reach.count()
        if now == count:
            return reach.filter("name = uses").select("name").distinct()
        count = now
        further = reach.withColumnRenamed("uses", "via").join(pairs.withColumnRenamed("name", "via"), "via").select("name", "uses")
        reach = reach.unionByName(further).distinct()


def cycles(nodes: DataFrame) -> DataFrame:
    """(workflow_id, problem) of graphs with a cycle, by peeling levels.

    A cycle goes up somewhere, so graphs all of whose nodes depend on smaller indices have none and are not peeled.
    """
    up = edges(nodes).filter("dep >= task_index").select("workflow_id").distinct()
    left = edges(nodes).join(up, "workflow_id", "left_semi").distinct()
    count = -1
    while True:
        left = written(left, "dag-peel")
        now = left.count()
        if now in (0, count):
            return left.select("workflow_id", F.lit("cycle").alias("problem")).distinct()
        count = now
        # An edge goes when what it leads to has no edges of its own.
        left = left.join(left.select("workflow_id", F.col("task_index").alias("dep")).distinct(), ["workflow_id", "dep"], "left_semi").select("workflow_id", "task_index", "dep")
