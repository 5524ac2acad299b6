"""Near-duplicate vectors by NN-descent over a neighbour graph.

Identical vectors are one node with a multiplicity. The first graph comes from
buckets of random hyperplanes; the more bits a bucket has, the more tables
there are, so that a pair at the threshold shares a bucket in some table with a
probability of `COLLISION` whatever the size of the table. Then rounds of neighbours-of-neighbours joins
refine it: every node's neighbours, forward and reverse, meet at the node and
are compared with each other; what beats a neighbour list's worst entry
replaces it. Rounds end when few entries change.

A list whose entries all reach the threshold is saturated: its node may have
more partners than it can hold, also in other groups. All links of saturated
nodes are found without lists: the nodes are covered with balls, the leader of
each ball meets every node of the table, and who is near enough to link with
anything in the ball (by the triangle inequality of angles) meets the whole
ball in blocks. Links are counted there and components joined, so no list has
to hold them and no pair is written. A link between two unsaturated nodes that
was ever compared is in their lists.

An audit compares nodes with all others by brute force, more and more of them
until it has seen `MIN_LINKS` true links. If there are so few links that it has
not after its limit, recall is measured at the links that an independent set of
tables finds, each with a probability of `COLLISION`. While the final links and components lack more of the true links than `recall`
allows, descent goes on with longer lists. If `ATTEMPTS` descents are not
enough, every node is treated as saturated, which finds all links.

Vectors travel in half precision, which moves a cosine by less than `MARGIN`
whatever the number of components. What may link is decided by one test, in
lists, blocks and audits alike: the dot product by the root of the product of
the squared norms, all in double precision and summed up in the same order.

Results, also for odd input:

* vectors that are null, all zero, empty, or hold null or non-finite
  components link with nothing and are their own component;
* rows without an id take part, but name no component; a component without
  any id has a null id, and `kept` is false for rows without an id;
* repeated rows link with each other, and each gets a result row;
* vectors shorter than the longest one are filled up with zeros;
* cosines equal to the threshold link, as far as doubles tell; an empty table gives no rows;
* columns beside id and vector are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queuelens.llm.common import shared_dir, written
from queuelens.llm.components import components
from queuelens.llm.vectors import bounds, map_groups, matrix, usable

LISTS = 10
#: Tables of hyperplanes that give neighbours; further ones give near pairs alone.
TABLES = 6
#: Probability that a pair at the threshold shares a bucket in some table.
COLLISION = 0.99
BUCKET = 256
#: Nodes of a bucket or component that meet in one task.
BLOCK = 512
#: Nodes of a ball, and of its reach, that meet in one task: a vector is sent once for so many others.
MEET = 2048
MAX_ROUNDS = 8
#: Descents with longer and longer lists before all nodes are compared.
ATTEMPTS = 3
#: Nodes first audited, and true links that an audit has to see.
AUDITED = 256
MIN_LINKS = 100
#: An audit ends at so many nodes or so many comparisons, whichever are more.
AUDIT_NODES = 1 << 14
AUDIT_PAIRS = 1 << 33
#: Vectors of half precision may miss a cosine by as much: twice 2**-11, and rounding.
MARGIN = 1.5e-3
#: How much better than the worst entry of a full list a new one must be.
STEP = 1e-3
#: Products of unit vectors miss a cosine in double precision by less.
SLACK = 1e-9
#: Cosine to its leader that a node has at least when it joins a ball.
NEAR_LEADER = 0.96
#: Bytes of vectors that meet all nodes in one pass.
PASS_BYTES = 4 << 20
_GRAPH = "node long, other long, sim double"


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles, scaled by powers of two so that no product over- or underflows; that changes no cosine."""
    rows = matrix(column, dim)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def _units(column: pa.Array, dim: int) -> np.ndarray:
    return _normal(_rows(column, dim))


def _normal(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with the same row of y: what decides whether they link."""
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x link with which of y, as `cosines` has it; products of unit vectors leave only those at the threshold to it."""
    product = _normal(x) @ _normal(y).T
    out = product >= threshold
    i, j = np.nonzero(np.abs(product - threshold) <= SLACK)
    for a in range(0, len(i), 1 << 12):
        part = slice(a, a + (1 << 12))
        out[i[part], j[part]] = cosines(x[i[part]], y[j[part]]) >= threshold
    return out


def nodes_of(vectors: DataFrame, vector_col: str) -> DataFrame:
    """(node, v, many): distinct usable vectors, how often they occur."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = usable(F.col(vector_col)) & F.exists(F.col(vector_col), lambda x: x != 0)
    distinct = vectors.filter(fine).select(v.alias("v")).groupBy("v").agg(F.count("*").alias("many"))
    return written(distinct.select(F.monotonically_increasing_id().alias("node"), "v", "many"), "vectors-nodes")


def _graph_batch(node, other, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(sim, pa.float64())], names=["node", "other", "sim"])


def _best(ids: np.ndarray, sims: np.ndarray, k: int):
    """Each row's k largest entries, itself excluded: (node, other, sim)."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], sims[0, :0]
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(sims, at, axis=1).ravel()


def _shrunk(batch: pa.RecordBatch, dim: int) -> pa.Array:
    """Unit vectors in half precision."""
    return pa.array([r.tobytes() for r in _units(batch.column("v"), dim).astype(np.float16)], pa.binary())


def _grown(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
    norm = np.linalg.norm(rows, axis=1)
    return rows / np.where(norm > 0, norm, 1)[:, None]


def tables_for(bits: int, threshold: float) -> int:
    """Tables in one of which a pair at the threshold shares a bucket with the wanted probability."""
    shared = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return TABLES if shared >= 1 else max(TABLES, int(np.ceil(np.log(1 - COLLISION) / np.log1p(-shared))))


def first_graph(nodes: DataFrame, dim: int, count: int, k: int, threshold: float, seed: int = 7, near_only: bool = False) -> DataFrame:
    """Neighbours within the buckets of tables of random hyperplanes; with `near_only` just those that may link."""
    bits = max(1, int(np.ceil(np.log2(max(2, count / BUCKET)))))
    tables = tables_for(bits, threshold)

    def codes(batches):
        planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                side = (matrix(batch.column("v"), dim) @ planes > 0).reshape(-1, tables, bits)
                bucket = side @ (1 << np.arange(bits)) + (np.arange(tables) << bits)
                ids = batch.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, tables)), pa.array(bucket.ravel().astype(np.int64))], names=["node", "bucket"])

    def shrink(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), _shrunk(batch, dim)], names=["node", "v"])

    placed = written(nodes.select("node", "v").mapInArrow(codes, "node long, bucket long"), "vectors-buckets")
    # Large buckets are dealt out into blocks.
    blocks = placed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    further = F.lit(True) if near_only else F.col("bucket") >= (TABLES << bits)
    placed = placed.join(blocks, "bucket").select("node", further.alias("further"), F.xxhash64("bucket", F.pmod(F.xxhash64("node", "bucket"), "blocks")).alias("place"))
    met = placed.join(nodes.select("node", "v").mapInArrow(shrink, "node long, v binary"), "node")

    def work(table: pa.Table):
        ids, rows = table.column("node").to_numpy(), _grown(table.column("v"), dim)
        only = table.column("further").to_numpy(zero_copy_only=False)
        edge = bounds(table.column("place").to_numpy())
        for a, b in zip(edge[:-1], edge[1:]):
            node, other, sim = _best(ids[a:b], rows[a:b] @ rows[a:b].T, k)
            keep = sim >= (threshold - MARGIN if only[a] else -2)
            yield _graph_batch(node[keep], other[keep], sim[keep].astype(float))

    return map_groups(met.select("place", "further", "node", "v"), "place", work, _GRAPH)


def _top(graph: DataFrame, k: int) -> DataFrame:
    """The k best distinct entries of each node's list."""
    once = graph.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def descend(graph: DataFrame, nodes: DataFrame, dim: int, k: int) -> DataFrame:
    """One round: neighbours of a common node are compared with each other.

    Returns entries that are better than the worst of the node's list.
    """
    # Reverse neighbours: as many as a list holds, which differ between rounds' graphs.
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim")
    order = Window.partitionBy("node").orderBy(F.xxhash64("other"))
    back = back.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    met = graph.select("node", "other").unionByName(back.select("node", "other")).unionByName(nodes.select("node", F.col("node").alias("other"))).distinct()
    worst = graph.groupBy("node").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    # What travels is in half precision; links are computed anew in the end.
    small = nodes.join(worst, "node", "left").select(F.col("node").alias("other"), "v", F.coalesce("worst", F.lit(-2.0)).alias("worst"))

    def shrink(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("other"), _shrunk(batch, dim), batch.column("worst")], names=["other", "v", "worst"])

    met = met.join(small.mapInArrow(shrink, "other long, v binary, worst double"), "other")

    def work(table: pa.Table):
        centre = table.column("node").to_numpy()
        ids, worst = table.column("other").to_numpy(), table.column("worst").to_numpy()
        rows = _grown(table.column("v"), dim)
        edge = bounds(centre)
        size = np.diff(edge)
        for n in np.unique(size):  # groups of equal size at once
            for part in np.array_split(edge[:-1][size == n], max(1, int((size == n).sum()) // 256)):
                at = part[:, None] + np.arange(n)
                block = rows[at]
                sims = block @ block.transpose(0, 2, 1)
                good = sims > worst[at][:, :, None] + STEP
                good[:, np.arange(n), np.arange(n)] = False
                g, i, j = np.nonzero(good)
                yield _graph_batch(ids[at[g, i]], ids[at[g, j]], sims[g, i, j].astype(float))

    found = map_groups(met.select("node", "other", "v", "worst"), "node", work, _GRAPH)
    return _top(found, k)


def exact_links(pairs: DataFrame, nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(u, v) of the pairs (node, other) whose cosine in doubles reaches the threshold, each once, u < v."""
    once = pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
    full = once.join(nodes.select(F.col("node").alias("u"), F.col("v").alias("x")), "u").join(nodes.select(F.col("node").alias("v"), F.col("v").alias("y")), "v")

    def run(batches):
        for batch in batches:
            linked = cosines(_rows(batch.column("x"), dim), _rows(batch.column("y"), dim)) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(linked))

    return full.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _counts(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n): linked vectors of each node, by its links."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(nodes.select(F.col("node").alias("v"), "many"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("many").alias("n"))


def saturated(graph: DataFrame, k: int, threshold: float) -> DataFrame:
    """(node): nodes whose lists of k entries hold nothing that is surely no link, so that there may be more."""
    lists_ = graph.groupBy("node").agg(F.min("sim").alias("least"), F.count("*").alias("entries"))
    return lists_.filter((F.col("entries") >= k) & (F.col("least") >= threshold - MARGIN - STEP)).select("node")


def balls(full: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """(node, ball): a leader near each node of `full` (node, root), itself one of them.

    Leaders are chosen within blocks of a component, then among the leaders
    so found, until that leaves about as many.
    """

    def work(table: pa.Table):
        ids, rows = table.column("node").to_numpy(), _units(table.column("v"), dim)
        edge = bounds(table.column("place").to_numpy())
        for a, b in zip(edge[:-1], edge[1:]):
            leader = np.full(b - a, -1)
            while (leader < 0).any():
                first = int(np.argmax(leader < 0))
                leader[(leader < 0) & (rows[a:b] @ rows[a + first] >= NEAR_LEADER)] = first
                leader[first] = first
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(ids[a:b][leader])], names=["node", "ball"])

    member, leaders, before = full.select("node", F.col("node").alias("ball")), full, full.count()
    while True:
        size = leaders.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        placed = leaders.join(size, "root").select("node", F.xxhash64("root", F.pmod(F.xxhash64("node", F.lit(before)), "blocks")).alias("place"))
        step = written(map_groups(placed.join(nodes.select("node", "v"), "node").select("place", "node", "v"), "place", work, "node long, ball long"), "vectors-leaders")
        member = written(member.join(step.select(F.col("node").alias("ball"), F.col("ball").alias("next")), "ball").select("node", F.col("next").alias("ball")), "vectors-balls")
        leaders = written(leaders.join(step.filter("node = ball"), "node", "left_semi"), "vectors-leaders")
        after = leaders.count()
        if after > 0.5 * before:
            return member
        before = after


def within_reach(member: DataFrame, nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(node, ball): all nodes of the table that may link with something in a ball."""
    pairs = member.join(nodes.select("node", "v"), "node").join(nodes.select(F.col("node").alias("ball"), F.col("v").alias("w")), "ball")

    def angles(batches):
        for batch in batches:
            cosine = (_units(batch.column("v"), dim) * _units(batch.column("w"), dim)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("ball"), pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["ball", "angle"])

    radius = pairs.select("ball", "v", "w").mapInArrow(angles, "ball long, angle double").groupBy("ball").agg(F.max("angle").alias("radius"))
    leaders = written(radius.join(nodes.select(F.col("node").alias("ball"), "v"), "ball"), "vectors-leaders")
    passes = -(-leaders.count() * 8 * dim // PASS_BYTES)
    path = shared_dir(nodes.sparkSession, "vectors-reach")
    for i in range(passes):
        some = leaders.filter(F.pmod(F.xxhash64("ball"), F.lit(passes)) == i).toArrow()
        if not some.num_rows:
            continue
        ids, rows = some.column("ball").to_numpy(), _units(some.column("v"), dim)
        least = np.cos(np.minimum(np.pi, np.arccos(threshold) + some.column("radius").to_numpy())) - 1e-6

        def meet(batches, ids=ids, rows=rows, least=least):
            for batch in batches:
                own, node = _units(batch.column("v"), dim), batch.column("node").to_numpy()
                for a in range(0, len(own), BLOCK):
                    i, j = np.nonzero(own[a : a + BLOCK] @ rows.T >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(node[a + i]), pa.array(ids[j])], names=["node", "ball"])

        nodes.select("node", "v").mapInArrow(meet, "node long, ball long").write.mode("append").parquet(path)
    return nodes.sparkSession.read.schema("node long, ball long").parquet(path)


def _joined(linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column the least id it is linked with, over any number of links."""
    none = np.iinfo(np.int64).max
    while True:
        low_y = np.minimum(y, np.where(linked, x[:, None], none).min(axis=0))
        low_x = np.minimum(x, np.where(linked, low_y, none).min(axis=1))
        if (low_x == x).all() and (low_y == y).all():
            return x, y
        x, y = low_x, low_y


def complete(full: DataFrame, nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(node, n, root), several rows a node: all links with a node of `full` (node, root) at one end.

    The sum of a node's n are its links with such nodes, for a node of `full`
    its links with any; and a root is a node of the same component.
    """
    member = balls(full, nodes, dim)
    reach = within_reach(member, nodes, dim, threshold).join(full.select("node", F.lit(True).alias("full")), "node", "left")
    blocks = lambda df, name: df.groupBy("ball").agg(F.ceil(F.count("*") / MEET).cast("long").alias(name))
    sizes = written(blocks(member, "rows").join(blocks(reach, "columns"), "ball"), "vectors-sizes")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = member.join(sizes, "ball").select("node", "ball", F.lit(True).alias("full"), F.lit(True).alias("member"), F.pmod(F.xxhash64("node"), "rows").alias("row"), upto("columns").alias("column"))
    columns = reach.join(sizes, "ball").select("node", "ball", F.coalesce("full", F.lit(False)).alias("full"), F.lit(False).alias("member"), upto("rows").alias("row"), F.pmod(F.xxhash64("node"), "columns").alias("column"))
    met = rows.unionByName(columns).select("node", "full", "member", F.xxhash64("ball", "row", "column").alias("place")).join(nodes, "node")

    def work(table: pa.Table):
        ids, many, place = (table.column(c).to_numpy() for c in ("node", "many", "place"))
        inside, is_full = (table.column(c).to_numpy() for c in ("member", "full"))
        vectors = _rows(table.column("v"), dim)
        edge = bounds(place)
        for a, b in zip(edge[:-1], edge[1:]):
            x, y = np.flatnonzero(inside[a:b]) + a, np.flatnonzero(~inside[a:b]) + a
            if not len(x) or not len(y):
                continue
            linked = near(vectors[x], vectors[y], threshold) & (ids[x][:, None] != ids[y])
            low_x, low_y = _joined(linked, ids[x], ids[y])
            # Two nodes of `full` meet twice: each of them is once the one within reach.
            n = [linked @ (many[y] * ~is_full[y]), many[x] @ linked]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(ids[x], ids[y])), pa.array(np.append(*n)), pa.array(np.append(low_x, low_y))], names=["node", "n", "root"])

    return map_groups(met.select("place", "node", "full", "member", "v", "many"), "place", work, "node long, n long, root long")


def settle(graph: DataFrame, full: DataFrame, nodes: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links per node, (node, n), and components, (node, root): those of the lists and all of the nodes `full`."""
    links = written(exact_links(graph.filter(F.col("sim") >= threshold - MARGIN), nodes, dim, threshold), "vectors-links")
    roots = written(components(links), "vectors-roots")
    full = written(full.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "vectors-saturated")
    if not full.limit(1).count():
        return written(_counts(links, nodes), "vectors-counts"), roots
    whole = written(complete(full, nodes, dim, threshold), "vectors-complete")
    edges = links.unionByName(whole.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
    for end in ("u", "v"):
        links = links.join(full.select(F.col("node").alias(end)), end, "left_anti")
    counts = _counts(links, nodes).unionByName(whole.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    return written(counts, "vectors-counts"), written(components(edges), "vectors-roots")


def _audited(few: pa.Table, nodes: DataFrame, counts: DataFrame, roots: DataFrame, dim: int, threshold: float) -> tuple[int, int]:
    """(true, found): links of the nodes `few`, which are all compared with every node."""
    ids, rows = few.column("node").to_numpy(), _rows(few.column("v"), dim)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                q, c = np.nonzero(near(rows, _rows(batch.column("v"), dim), threshold))
                other, many = (batch.column(name).to_numpy()[c] for name in ("node", "many"))
                own = ids[q] == other
                yield pa.RecordBatch.from_arrays([pa.array(ids[q][~own]), pa.array(other[~own]), pa.array(many[~own])], names=["node", "other", "many"])

    return _recalled(nodes.select("node", "v", "many").mapInArrow(run, "node long, other long, many long"), counts, roots)


def _recalled(true: DataFrame, counts: DataFrame, roots: DataFrame) -> tuple[int, int]:
    """(true, found) of true links (node, other, many): a node finds as many as it counts and has in its component."""
    root = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    together = F.when(F.col("node_root") == F.col("other_root"), F.col("many")).otherwise(0)
    true = true.join(root("node"), "node", "left").join(root("other"), "other", "left").groupBy("node").agg(F.sum("many").alias("true"), F.sum(together).alias("together"))
    sums = true.join(counts, "node", "left").agg(F.sum("true").alias("t"), F.sum(F.least("together", F.coalesce("n", F.lit(0)))).alias("f")).first()
    return sums.t or 0, sums.f or 0


def probe(nodes: DataFrame, counts: DataFrame, roots: DataFrame, dim: int, count: int, k: int, threshold: float) -> tuple[float, DataFrame]:
    """(recall, links) at the links that tables independent of the first ones find.

    Each link shares a bucket there with a probability of `COLLISION`; without
    any, it is as unlikely that there are some.
    """
    candidates = first_graph(nodes, dim, count, k, threshold, seed=11, near_only=True)
    links = written(exact_links(candidates, nodes, dim, threshold), "vectors-probe")
    both = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("other")))
    true, found = _recalled(both.join(nodes.select(F.col("node").alias("other"), "many"), "other"), counts, roots)
    return found / true if true else 1.0, links


def audit(nodes: DataFrame, counts: DataFrame, roots: DataFrame, dim: int, threshold: float) -> float | None:
    """Recall of the final links at the audited nodes; None if too few links were seen to tell.

    A link whose ends are in different components is lost, whatever was counted.
    """
    count = nodes.count()
    parts = -(-count // AUDITED)
    most = max(AUDIT_NODES, AUDIT_PAIRS // max(1, count)) // AUDITED
    done, step, true, found = 0, 1, 0, 0
    while done < min(parts, most) and true < MIN_LINKS:
        part = F.pmod(F.xxhash64("node"), F.lit(parts))
        few = nodes.filter((part >= done) & (part < done + step)).select("node", "v").toArrow()
        done += step
        step = max(1, min(4 * step, PASS_BYTES // (8 * dim * AUDITED)))
        if few.num_rows:
            t, f = _audited(few, nodes, counts, roots, dim, threshold)
            true, found = true + t, found + f
    if true < MIN_LINKS and done < parts and found == true:
        return None
    return found / true if true else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.99, k: int = LISTS) -> DataFrame:
    """(id, n_links, component_id, kept) for each row. See the module's docstring."""
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    nodes = nodes_of(vectors, "vector")
    facts = nodes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim, count = facts.dim or 1, facts.n
    graph = written(_top(first_graph(nodes, dim, count, k, threshold), k), "vectors-graph")
    for attempt in range(ATTEMPTS):
        k *= 2 if attempt else 1
        for _ in range(MAX_ROUNDS):
            found = written(descend(graph, nodes, dim, k), "vectors-found")
            new = written(_top(graph.unionByName(found), k), "vectors-graph")
            changed = new.join(graph, ["node", "other"], "left_anti").count()
            graph = new
            if changed <= 0.01 * count * k:
                break
        counts, roots = settle(graph, saturated(graph, k, threshold), nodes, dim, threshold)
        reached = audit(nodes, counts, roots, dim, threshold)
        if reached is None:
            reached, links = probe(nodes, counts, roots, dim, count, k, threshold)
            if reached < recall:  # what the probe found joins the lists
                ends = links.select(F.col("u").alias("node"), F.col("v").alias("other"), F.lit(float(threshold)).alias("sim"))
                more = ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim"))
                graph = written(_top(graph.unionByName(more), 2 * k), "vectors-graph")
        if reached >= recall:
            break
    else:
        counts, roots = settle(graph, nodes.select("node"), nodes, dim, threshold)
    per_node = nodes.join(counts, "node", "left").join(roots, "node", "left").select("v", "many", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = vectors.withColumn("v", F.transform("vector", lambda x: x.cast("double"))).drop("vector")
    rows = written(rows.join(per_node, "v", "left").select("id", "root", F.coalesce(F.col("n") + F.col("many") - 1, F.lit(0)).alias("n_links")), "vectors-rows")
    least = rows.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))
    out = rows.join(least, "root", "left").select("id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
