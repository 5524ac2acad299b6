"""From nodes to tasks and child workflows, and back to the parent's node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.functions import results
from queuelens.operators.dag import ended_value, told
from queuelens.schemas import WORKFLOW_TERMINAL

#: Keys of a task's arguments that hold an injected result, the context of its workflow, and what node it is.
RESULT_TAG, CONTEXT, META = "__injected_result__", "__workflow_ctx__", "__workflow_meta__"


def results_with_names(nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(workflow_id, task_index, node_id, by_name, status, result) of ended nodes; `by_name` is what others may call them.

    Of `asked` (workflow_id, node_id), if given. Skipped nodes and results that
    can't be read have a sentinel; nodes without a result are left out.
    """
    done = nodes.filter(told()).withColumn("result", ended_value())
    if asked is not None:
        done = done.join(asked.select("workflow_id", "node_id").distinct(), ["workflow_id", "node_id"], "left_semi")
    name = F.concat_ws("#", F.coalesce("task_name", F.lit("task")), F.col("task_index").cast("string"))
    return done.select("workflow_id", "task_index", "node_id", name.alias("by_name"), "status", "result")


def context(nodes: DataFrame) -> DataFrame:
    """(workflow_id, task_index, results): results by node id of the nodes that a node asks to see, those without one left out."""
    return _context(nodes, nodes.filter(told()))


def _context(asking: DataFrame, done: DataFrame) -> DataFrame:
    wanted = asking.select("workflow_id", "task_index", F.explode(F.array_distinct("workflow_ctx_from")).alias("node_id"))
    source = done.select("workflow_id", "node_id", "status", "result", F.col("task_index").alias("dep"))
    met = wanted.join(source, ["workflow_id", "node_id"]).withColumn("value", F.expr(results.seen_by_others(task_index="dep")))
    return met.groupBy("workflow_id", "task_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "value")))).alias("results"))


def _members(column: str, key: str) -> str:
    """SQL of the JSON members of an array of structs of names and JSON texts, as one text; empty for null."""
    return f"coalesce(array_join(transform({column}, e -> concat({results.text('e.' + key)}, ':', e.value)), ','), '')"


def arguments(nodes: DataFrame, which: Column | None = None, tag: str = RESULT_TAG) -> DataFrame:
    """(workflow_id, task_index, kwargs, code, message) of the nodes that `which` names, of all without it.

    `args_from` maps an argument to the index of the node whose result it gets:
    {tag: true, "data": text of the result}. Only dependencies that have ended
    with a result give one. Nodes with a context have `CONTEXT`, with results
    and summaries by node id as texts; all have `META`. A node whose options or
    own arguments are no JSON object, or that gets an argument that it has
    already, has no kwargs but the code and message of its error. Own arguments
    keep their order; arguments of other kinds than an object count as none.
    """
    which = F.lit(True) if which is None else which
    sub = F.when(F.col("is_subworkflow"), "subworkflow ").otherwise("") if "is_subworkflow" in nodes.columns else F.lit("")
    optional = lambda c, kind: (F.col(c) if c in nodes.columns else F.lit(None).cast(kind)).alias(c)
    own = nodes.filter(which).select("workflow_id", "task_index", optional("task_name", "string"), "dependencies", optional("task_kwargs", "string"), optional("task_options", "string"), optional("args_from", "map<string,int>"), optional("workflow_ctx_from", "array<string>"), sub.alias("_kind"))
    done = nodes.filter(told())
    source = done.select("workflow_id", F.col("task_index").alias("dep"), "status", "result")
    asked = own.select("workflow_id", "task_index", "dependencies", F.explode("args_from").alias("arg", "dep")).filter("array_contains(dependencies, dep)").join(source, ["workflow_id", "dep"])
    # Values are made of results that are asked for only.
    asked = asked.withColumn("value", F.expr(results.seen_by_others(task_index="dep")))
    part = F.expr(f"""struct(arg as key, concat('{{"{tag}":true,"data":', {results.text("value")}, '}}') as value)""")
    injected = asked.groupBy("workflow_id", "task_index").agg(F.array_sort(F.collect_list(part)).alias("injected"))
    seen = _context(own, done).select("workflow_id", "task_index", F.expr(f"transform(map_entries(results), e -> struct(e.key as key, {results.text('e.value')} as value))").alias("seen"))
    out = own.join(injected, ["workflow_id", "task_index"], "left").join(seen, ["workflow_id", "task_index"], "left")
    if {"sub_workflow_summary", "is_subworkflow"} <= set(nodes.columns):
        wanted = own.select("workflow_id", "task_index", F.explode(F.array_distinct("workflow_ctx_from")).alias("node_id"))
        known = nodes.filter("is_subworkflow and sub_workflow_summary is not null").select("workflow_id", "node_id", F.expr(results.text("sub_workflow_summary")).alias("value"))
        sums = wanted.join(known, ["workflow_id", "node_id"]).groupBy("workflow_id", "task_index").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("key"), "value"))).alias("told"))
        out = out.join(sums, ["workflow_id", "task_index"], "left")
    else:
        out = out.withColumn("told", F.lit(None).cast("array<struct<key: string, value: string>>"))
    place = {"workflow_id": results.text("workflow_id"), "task_index": "cast(task_index as string)", "task_name": results.text("task_name")}
    ctx = results.obj(**place, results_by_id=f"concat('{{', {_members('seen', 'key')}, '}}')", summaries_by_id=f"concat('{{', {_members('told', 'key')}, '}}')")
    out = out.withColumns({"_given": F.expr("nullif(task_kwargs, '')"), "_options": F.expr("nullif(task_options, '')")})
    out = out.withColumn("_static", F.expr(f"case when {results.is_object('_given')} then get_json_object(_given, '$') end"))
    body = "nullif(regexp_extract(_static, '(?s)^.(.*).$', 1), '')"
    kwargs = f"""concat('{{', concat_ws(',', {body}, nullif({_members("injected", "key")}, ''), case when size(workflow_ctx_from) > 0 then concat('"{CONTEXT}":', {ctx}) end, concat('"{META}":', {results.obj(**place)})), '}}')"""
    # The first conflict by length, then by name.
    both = "transform(array_intersect(map_keys(args_from), coalesce(json_object_keys(_static), cast(array() as array<string>))), k -> struct(length(k) as n, k as k))"
    out = out.withColumn("_clash", F.expr(f"try_element_at(array_sort({both}), 1).k"))
    index = "cast(task_index as string)"
    faults = [
        (f"_kind = '' and _options is not null and not {results.is_value('_options')}", results.NOT_SERIAL, f"concat('Corrupt task_options JSON for task ', {index})"),
        (f"_kind = '' and _options is not null and not {results.is_object('_options')}", results.NOT_SERIAL, f"concat('Invalid task_options payload for task ', {index}, ': expected object')"),
        (f"_given is not null and not {results.is_value('_given')}", results.NOT_SERIAL, f"concat('Corrupt kwargs JSON for ', _kind, 'task ', {index})"),
        ("_clash is not null", results.ENQUEUE_FAILED, f"concat('args_from key \\'', _clash, '\\' conflicts with static kwarg (', _kind, 'task ', {index}, ')')"),
    ]
    fault = "case " + " ".join(f"when {when} then struct('{code}' as code, {message} as message)" for when, code, message in faults) + " end"
    out = out.withColumn("_fault", F.expr(fault))
    return out.select("workflow_id", "task_index", F.expr(f"case when _fault is null then {kwargs} end").alias("kwargs"), "_fault.code", "_fault.message")


def tasks_of(nodes: DataFrame, as_of: Column) -> DataFrame:
    """The tasks that enqueued nodes become: new rows with an id of their own place in the workflow."""
    ready = nodes.filter((F.col("status") == "ENQUEUED") & ~F.col("is_subworkflow"))
    columns = [c for c in ("task_name", "queue_name", "priority", "task_options") if c in nodes.columns]
    return ready.select(place_id().alias("id"), *columns, F.lit("PENDING").alias("status"), as_of.alias("enqueued_at"), F.lit(0).alias("retry_count"))


def place_id() -> Column:
    """The id of the task or child workflow that a node becomes: its workflow and index."""
    return F.concat_ws("/", "workflow_id", F.col("task_index").cast("string"))


def link(nodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Nodes with the id of the task that `tasks_of` made for them."""
    made = tasks.select(F.col("id").alias("_task"))
    name = F.concat_ws("/", "workflow_id", F.col("task_index").cast("string"))
    return nodes.join(made, name == F.col("_task"), "left").withColumn("task_id", F.coalesce("_task", "task_id")).drop("_task").select(nodes.columns)


def children_of(nodes: DataFrame, workflows: DataFrame, as_of: Column) -> DataFrame:
    """The child workflows that enqueued sub-workflow nodes start: one level deeper, under the same root."""
    parents = workflows.select(F.col("id").alias("workflow_id"), F.col("depth").alias("_depth"), "root_workflow_id", "name")
    started = nodes.filter((F.col("status") == "ENQUEUED") & F.col("is_subworkflow")).join(parents, "workflow_id")
    return started.select(F.concat_ws("/", "workflow_id", F.col("task_index").cast("string")).alias("id"), "name", F.lit("RUNNING").alias("status"), F.col("workflow_id").alias("parent_workflow_id"), F.col("task_index").alias("parent_task_index"), (F.col("_depth") + 1).alias("depth"), "root_workflow_id", as_of.alias("created_at"))


def parent_results(children: DataFrame) -> DataFrame:
    """(workflow_id, task_index, to, outcome, summary) for the parents' nodes, from `dag.child_summary` rows of ended children.

    A completed child's result is the node's; another child's end is an error
    that names it and holds the summary.
    """
    done = children.filter(F.col("status").isin(*WORKFLOW_TERMINAL))
    fine = F.col("status") == "COMPLETED"
    output = results.member(results.canonical("result"), ".ok")
    # The error's message; an error that is no JSON is shown itself, up to 200 characters.
    own = results.member("error", ".message")
    said = f"case when nullif(error, '') is null then null when {results.is_object('error')} then case when startswith({own}, '\"') then {own} end when not {results.is_value('error')} then {results.text('substring(error, 1, 200)')} end"
    count = lambda c: f"cast({c} as string)"
    summary = results.obj(status=results.text("status"), output=output, total_tasks=count("total"), completed_tasks=count("completed"), failed_tasks=count("failed"), skipped_tasks=count("skipped"), error_summary=said)
    message = "concat('Subworkflow ', id, ' failed with status ', status)"
    err = results.obj(**{results.ERROR: "'true'", "error_code": f"""'{{"{results.BUILT_IN}":"{results.CHILD_FAILED}"}}'""", "data": "'null'", "message": results.text(message), "sub_workflow_id": results.text("id"), "sub_workflow_summary": "summary"})
    return done.withColumn("summary", F.expr(summary)).select(F.col("parent_workflow_id").alias("workflow_id"), F.col("parent_task_index").alias("task_index"), F.when(fine, "COMPLETED").otherwise("FAILED").alias("to"), F.when(fine, F.col("result")).otherwise(F.expr(results.failed(err))).alias("outcome"), "summary")
