"""Claiming: which tasks workers may take, by priority and under caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.functions.times import seconds
from queuelens.operators.health import active_claim
from queuelens.operators.transitions import update

ORDER = ("priority", "enqueued_at", "id")


def claimable(as_of: Column) -> Column:
    """Pending, or claimed under a lease that is over; due, and not past the deadline."""
    open_lease = (F.col("status") == "PENDING") | ((F.col("status") == "CLAIMED") & (F.col("claim_expires_at") < as_of))
    due = (F.col("enqueued_at") <= as_of) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of))
    return open_lease & due & (F.col("good_until").isNull() | (F.col("good_until") > as_of))


def claimable_top_k(tasks: DataFrame, as_of: Column, k: int) -> DataFrame:
    """The first k claimable tasks of each queue; tasks prune to k per queue before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("queue_name").orderBy(*ORDER))
    return tasks.filter(claimable(as_of)).withColumn("place", rank).filter(F.col("place") <= k).select("queue_name", "place", "id", "task_name", "priority")


def claim_budget(tasks: DataFrame, as_of: Column, worker: str, processes: int, prefetch: int = 0, max_claimed: int = 0, cluster_cap: int | None = None) -> DataFrame:
    """One row, (budget): how many tasks a worker's claiming round may take.

    Without prefetching its running and claimed tasks fill its processes; with
    it only running ones count against processes and prefetched tasks. A worker
    with `max_claimed` claims (by default as many as its capacity) takes none,
    and the cluster's cap, if any, is for all tasks in flight.
    """
    capacity = processes + prefetch
    own = F.coalesce(F.col("claimed_by_worker_id") == worker, F.lit(False))
    running, claimed = F.col("status") == "RUNNING", active_claim(as_of)
    counts = tasks.filter(F.col("status").isin("RUNNING", "CLAIMED")).agg(
        F.count_if(own & (running | claimed if prefetch == 0 else running)).alias("busy"), F.count_if(own & claimed).alias("held"), F.count_if(running | claimed).alias("all"))
    budget = F.greatest(F.lit(0), F.lit(capacity) - F.col("busy"))
    if cluster_cap is not None:
        budget = F.least(budget, F.greatest(F.lit(0), F.lit(cluster_cap) - F.col("all")))
    return counts.select(F.when(F.col("held") >= (max_claimed or capacity), F.lit(0)).otherwise(budget).cast("long").alias("budget"))


def claim_allocation(tasks: DataFrame, caps: DataFrame, as_of: Column, total: int, worker: str | None = None, max_claimed: int | None = None) -> DataFrame:
    """Tasks that one claiming round takes, with their order.

    `caps` has (queue_name, queue_order, cap, max_concurrency): the order in
    which queues are served, how many tasks the round may take from each, and
    the queue's cluster-wide limit or null. Going through the queues greedily
    until `total` is spent takes the same tasks as ranking within the queue,
    cutting at its cap, and ranking what is left over all queues; at most the
    sum of caps meets in the second ranking.
    """
    busy = tasks.filter(F.col("status").isin("RUNNING", "CLAIMED")).groupBy("queue_name").agg(F.count_if((F.col("status") == "RUNNING") | active_claim(as_of)).alias("busy"))
    room = caps.join(busy, "queue_name", "left").withColumn("room", F.greatest(F.lit(0), F.least("cap", F.coalesce(F.col("max_concurrency") - F.coalesce("busy", F.lit(0)), "cap"))))
    top = caps.agg(F.max("cap")).first()[0] or 0
    if worker is not None and max_claimed is not None:
        held = tasks.filter(active_claim(as_of) & (F.col("claimed_by_worker_id") == worker)).count()
        total = total if held < max_claimed else 0
    first = claimable_top_k(tasks, as_of, int(top)).join(F.broadcast(room.select("queue_name", "queue_order", "room")), "queue_name").filter(F.col("place") <= F.col("room"))
    order = F.row_number().over(Window.orderBy("queue_order", "place"))
    return first.withColumn("claim_order", order).filter(F.col("claim_order") <= total).select("claim_order", "queue_name", "place", "id")


def worker_budgets(tasks: DataFrame, workers: DataFrame, as_of: Column) -> DataFrame:
    """`workers` (worker_id, worker_order, processes, prefetch, max_claimed) with `budget`, as `claim_budget` has it for one; without the cluster's cap."""
    running, claimed = F.col("status") == "RUNNING", active_claim(as_of)
    own = tasks.filter(F.col("status").isin("RUNNING", "CLAIMED")).groupBy(F.col("claimed_by_worker_id").alias("worker_id")).agg(F.count_if(running).alias("_running"), F.count_if(claimed).alias("_held"))
    seen = workers.join(own, "worker_id", "left").fillna(0, ["_running", "_held"])
    capacity = F.col("processes") + F.col("prefetch")
    busy = F.col("_running") + F.when(F.col("prefetch") == 0, F.col("_held")).otherwise(0)
    most = F.when(F.col("max_claimed") > 0, F.col("max_claimed")).otherwise(capacity)
    budget = F.when(F.col("_held") >= most, 0).otherwise(F.greatest(F.lit(0), capacity - busy))
    return seen.withColumn("budget", budget.cast("long")).drop("_running", "_held")


def claims_of_workers(tasks: DataFrame, workers: DataFrame, caps: DataFrame, as_of: Column, cluster_cap: int | None = None) -> DataFrame:
    """(worker_id, queue_name, place, id): the tasks that all workers take, as if they claimed one after the other.

    In the order of `worker_order`, each worker goes through the queues and
    takes from each at most `cap` tasks, what other workers left of it and of
    its `max_concurrency`, and what is left of its own budget. What a worker
    finds in a queue depends on those before it there, and on itself in the
    queues before: so one running sum over the workers for each queue gives all
    numbers, and the tasks' ranks in their queues tell who gets which. The
    cluster's cap cuts the whole sequence.

    Queues and workers are configuration: a row of each per queue reaches the
    driver, and the workers meet in one task; tasks don't.
    """
    state = tasks.groupBy("queue_name").agg(F.count_if((F.col("status") == "RUNNING") | active_claim(as_of)).alias("busy"), F.count_if(claimable(as_of)).alias("open"))
    total = tasks.agg(F.count_if((F.col("status") == "RUNNING") | active_claim(as_of))).first()[0] if cluster_cap is not None else 0
    rows = caps.join(state, "queue_name", "left").fillna(0, ["busy", "open"]).orderBy("queue_order").collect()
    left = worker_budgets(tasks, workers, as_of).select("worker_id", "worker_order", F.col("budget").alias("_left"))
    before = Window.orderBy("worker_order", "worker_id").rowsBetween(Window.unboundedPreceding, -1)
    takes = []
    for i, q in enumerate(rows):
        there = q.open if q.max_concurrency is None else max(0, min(q.open, q.max_concurrency - q.busy))
        left = left.withColumn("_want", F.least(F.lit(q.cap), F.col("_left"))).withColumn("_start", F.least(F.coalesce(F.sum("_want").over(before), F.lit(0)), F.lit(there)))
        left = left.withColumn("_take", F.least(F.col("_want"), F.lit(there) - F.col("_start")))
        left = left.withColumns({"_left": F.col("_left") - F.col("_take"), f"_t{i}": F.struct(F.lit(q.queue_name).alias("queue_name"), F.lit(i).alias("no"), F.col("_start").alias("start"), F.col("_take").alias("take"))})
        takes.append(f"_t{i}")
    if not takes:
        return tasks.limit(0).select(F.lit("").alias("worker_id"), "queue_name", F.lit(0).alias("place"), "id")
    each = left.select("worker_id", "worker_order", F.explode(F.array(*takes)).alias("t")).filter("t.take > 0").select("worker_id", "worker_order", "t.*")
    if cluster_cap is not None:
        sofar = Window.orderBy("worker_order", "worker_id", "no").rowsBetween(Window.unboundedPreceding, -1)
        room = F.greatest(F.lit(0), F.lit(max(0, cluster_cap - total)) - F.coalesce(F.sum("take").over(sofar), F.lit(0)))
        each = each.withColumn("take", F.least("take", room)).filter("take > 0")
    places = each.select("worker_id", "queue_name", F.explode(F.expr("sequence(cast(start + 1 as int), cast(start + take as int))")).alias("place"))
    most = max((q.open if q.max_concurrency is None else max(0, min(q.open, q.max_concurrency - q.busy)) for q in rows), default=0)
    return claimable_top_k(tasks, as_of, int(most)).join(places, ["queue_name", "place"]).select("worker_id", "queue_name", "place", "id")


def claim_all(tasks: DataFrame, chosen: DataFrame, as_of: Column, lease: int = 60) -> DataFrame:
    """The next state of the tasks: each chosen one (id, worker_id) is claimed by its worker under a lease."""
    taken = chosen.select(F.col("id").alias("_id"), F.col("worker_id").alias("_worker"))
    flagged = tasks.join(taken, F.col("id") == F.col("_id"), "left")
    changes = {"status": F.lit("CLAIMED"), "claimed": F.lit(True), "claimed_at": as_of, "claimed_by_worker_id": F.col("_worker"), "claim_expires_at": as_of + seconds(lease), "updated_at": as_of}
    return update(flagged, F.col("_worker").isNotNull(), changes).drop("_id", "_worker")


def claim(tasks: DataFrame, chosen: DataFrame, as_of: Column, worker: str, lease: int = 60) -> DataFrame:
    """The next state of the tasks: the chosen ones are claimed by the worker under a lease."""
    taken = chosen.select(F.col("id").alias("_id"), F.lit(True).alias("_taken"))
    flagged = tasks.join(taken, F.col("id") == F.col("_id"), "left")
    changes = {"status": F.lit("CLAIMED"), "claimed": F.lit(True), "claimed_at": as_of, "claimed_by_worker_id": F.lit(worker), "claim_expires_at": as_of + seconds(lease), "updated_at": as_of}
    return update(flagged, F.col("_taken"), changes).drop("_id", "_taken")


def guard_workflows(tasks: DataFrame, nodes: DataFrame, workflows: DataFrame, as_of: Column) -> DataFrame:
    """Claimed tasks of paused workflows go back, those of cancelled ones are cancelled."""
    from queuelens.operators.health import nonrunnable_tasks
    from queuelens.operators.transitions import RELEASED

    stopped = nonrunnable_tasks(tasks, nodes, workflows).groupBy(F.col("id").alias("_id")).agg(F.max("workflow_status").alias("_stop"))
    flagged = tasks.join(stopped, F.col("id") == F.col("_id"), "left")
    back = update(flagged, (F.col("_stop") == "PAUSED") & (F.col("status") == "CLAIMED"), {"status": F.lit("PENDING"), **RELEASED(as_of)}, "paused")
    return update(back, (F.col("_stop") == "CANCELLED") & F.col("status").isin("CLAIMED", "PENDING"), {"status": F.lit("CANCELLED"), **RELEASED(as_of)}, "cancelled").drop("_id", "_stop")
