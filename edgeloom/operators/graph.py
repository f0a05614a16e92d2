"""Whole-graph operators on an edge table (Source, Target): degrees, components, clustering, centralities, paths.

Edges are a set: copies collapse first, self-loops stay. Nodes are the endpoints of edges. A null endpoint is no edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.hashing import key_hash
from edgeloom.operators import held, sketch
from edgeloom.operators.fixpoint import until_stable
from edgeloom.operators.split import induced, nodes
from edgeloom.session import cut, cut_counted, discard


class Graph:
    """A graph that is read several times: its distinct edges, and once asked for its degrees, written down once."""

    def __init__(self, edges: DataFrame) -> None:
        self.edges, (self.size,) = cut_counted(edges.where("Source is not null and Target is not null").select("Source", "Target").distinct())

    @cached_property
    def held(self) -> Broadcast | None:
        """The graph as every task holds it; None if it is too large for that."""
        return held.hold(self.edges) if self.size <= held.MAX_EDGES else None

    @cached_property
    def degrees(self) -> DataFrame:
        return cut(_degrees(self.edges))


Edges = DataFrame | Graph


def as_graph(edges: Edges) -> Graph:
    return edges if isinstance(edges, Graph) else Graph(edges)


def digraph(edges: Edges) -> DataFrame:
    """Distinct (Source, Target)."""
    if isinstance(edges, Graph):
        return edges.edges
    return edges.where("Source is not null and Target is not null").select("Source", "Target").distinct()


def node_set(edges: Edges) -> DataFrame:
    """(node): distinct endpoints."""
    return edges.degrees.select("node") if isinstance(edges, Graph) else nodes(digraph(edges))


def degrees(edges: Edges) -> DataFrame:
    """(node, in_degree, out_degree, degree): a self-loop counts on both sides. One shuffle, combined before it."""
    return edges.degrees if isinstance(edges, Graph) else _degrees(digraph(edges))


def _degrees(e: DataFrame) -> DataFrame:
    ends = F.explode(
        F.array(
            F.struct(F.col("Source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("Target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )
    ).alias("x")
    d = e.select(ends).groupBy(F.col("x.node").alias("node"))
    d = d.agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def graph_info(edges: Edges) -> DataFrame:
    """(nodes, edges, avg_in_degree, avg_out_degree) in one row."""
    d = degrees(edges)
    return d.agg(
        F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges"),
        F.round(F.avg("in_degree"), 6).alias("avg_in_degree"), F.round(F.avg("out_degree"), 6).alias("avg_out_degree"),
    )


def degree_histogram(edges: Edges, which: str = "degree") -> DataFrame:
    return degrees(edges).groupBy(F.col(which).alias("degree")).agg(F.count(F.lit(1)).alias("nodes"))


def undirected(edges: Edges) -> DataFrame:
    """(a, b, w), a < b: linked pairs without self-loops; w = 2 when both directions exist."""
    e = digraph(edges).where("Source <> Target")
    return e.groupBy(F.least("Source", "Target").alias("a"), F.greatest("Source", "Target").alias("b")).agg(F.count(F.lit(1)).alias("w"))


FEW = 10_000  # links that one task joins up by itself


def _union_find(links: DataFrame) -> DataFrame:
    """(node, into): the components of a few links, found by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x):  # noqa: ANN001, ANN202
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                up[find(a)] = find(b)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([find(x) for x in list(up)], kind)], ["node", "into"])

    kind = links.schema["a"].dataType.simpleString()
    return links.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, into {kind}")


def weak_components(edges: Edges, few: int = FEW) -> DataFrame:
    """(node, component): the smallest id of the weak component.

    Randomised contraction (Boegeholz, Brand and Todor, 2020): in a round every node joins the node of the smallest hash
    among itself and its neighbours, edges are carried over to those, and what is left shrinks by a factor, whatever
    the diameter. Minima are combined before the shuffle, so a hub's neighbours never meet in one task. Once at most ``few``
    links are left, one task joins them up, which saves the many short rounds of the end.
    """
    g = as_graph(edges)
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    live, (left,) = cut_counted(g.edges.where("Source <> Target").select(*pair("Source", "Target")).distinct())
    joined: list[DataFrame] = []
    while left:
        if left <= few:
            joined.append(cut(_union_find(live)))
            break
        ranked = lambda c, r=len(joined): F.struct(F.xxhash64(F.lit(r), F.col(c)), F.col(c).alias("id"))
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        best = both.groupBy("node").agg(F.min(ranked("other")).alias("m"))
        into = cut(best.select("node", F.least(F.col("m"), ranked("node"))["id"].alias("into")))
        joined.append(into)
        moved = live.join(into.toDF("a", "ia"), "a").join(into.toDF("b", "ib"), "b").where("ia <> ib").select(*pair("ia", "ib")).distinct()
        before = live
        live, (left,) = cut_counted(moved)
        discard(before)
    if not joined:
        return node_set(g).select("node", F.col("node").alias("component"))
    root = joined[-1].toDF("node", "root")
    for into in reversed(joined[:-1]):
        root = cut(into.join(root.toDF("into", "root"), "into", "left").select("node", F.coalesce("root", "into").alias("root")))
    name = root.groupBy("root").agg(F.min("node").alias("component"))
    got = root.join(name, "root").select("node", "component")
    return node_set(g).join(got, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_stats(components: DataFrame) -> DataFrame:
    """(components, largest, smallest, avg_size, std_size) with the population deviation."""
    s = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(
        F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.min("n").alias("smallest"),
        F.round(F.avg("n"), 6).alias("avg_size"), F.round(F.stddev_pop("n"), 6).alias("std_size"),
    )


def largest_component(components: DataFrame) -> DataFrame:
    """(node) of the largest component; among equals the one with the smallest id."""
    top = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return components.join(F.broadcast(top), "component", "left_semi").select("node")  # one row


def largest_wcc_edges(edges: DataFrame) -> DataFrame:
    return induced(edges, largest_component(weak_components(edges)))


def strong_components(edges: Edges) -> DataFrame:
    """(node, component): the smallest id of the strong component.

    Edges that start at a node without predecessors or end at one without successors lie on no cycle and are trimmed,
    round by round while that takes away a fifth of them. In what is left every node takes the smallest id that reaches it (its colour); within a colour, what
    reaches the colour's node is its component. All colours finish together; the rest goes round again.
    """
    g = as_graph(edges)
    every = node_set(g)
    e, (n,) = cut_counted(g.edges.where("Source <> Target"))
    settled: DataFrame | None = None
    while n:
        heads, tails = e.select("Target").toDF("Source").distinct(), e.select("Source").toDF("Target").distinct()
        trimmed, (m,) = cut_counted(e.join(heads, "Source", "left_semi").join(tails, "Target", "left_semi").select("Source", "Target"))
        discard(e)
        e, n, worthwhile = trimmed, m, m < 0.8 * n
        if worthwhile or not m:
            continue

        def spread(c: DataFrame, e: DataFrame = e) -> DataFrame:
            sent = e.join(c, e.Source == c.node).select(F.col("Target").alias("node"), "colour")
            return c.unionByName(sent).groupBy("node").agg(F.min("colour").alias("colour"))

        colour = until_stable(nodes(e).select("node", F.col("node").alias("colour")), spread)
        ca, cb = colour.toDF("Source", "ca"), colour.toDF("Target", "cb")
        same = cut(e.join(ca, "Source").join(cb, "Target").where("ca = cb").select("Source", "Target"))

        def back(r: DataFrame, same: DataFrame = same) -> DataFrame:
            return r.unionByName(same.join(r, same.Target == r.node).select(F.col("Source").alias("node"))).distinct()

        reached = until_stable(colour.where("node = colour").select("node"), back)
        found = cut(colour.join(reached, "node", "left_semi").select("node", F.col("colour").alias("component")))
        settled = found if settled is None else settled.unionByName(found)
        gone = found.select("node")
        before = e
        e, (n,) = cut_counted(e.join(gone.toDF("Source"), "Source", "left_anti").join(gone.toDF("Target"), "Target", "left_anti").select("Source", "Target"))
        discard(before, same, reached, colour)
    if settled is None:
        return every.select("node", F.col("node").alias("component"))
    return every.join(settled, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def clustering(edges: Edges) -> DataFrame:
    """(node, clustering): directed coefficient (Fagiolo, 2007), self-loops left out, 0 where there is no triangle.

    Each undirected triangle is found once from its corner of lowest degree, so a hub never expands its neighbours;
    the two directions of a link enter as its weight.
    """
    g = as_graph(edges)
    und = cut(undirected(g))
    deg = und.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    da, db = deg.toDF("a", "ka"), deg.toDF("b", "kb")
    low_first = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    lo, hi = F.when(low_first, F.struct("ka", "a")).otherwise(F.struct(F.col("kb").alias("ka"), F.col("b").alias("a"))), F.when(low_first, F.struct(F.col("kb").alias("ka"), F.col("b").alias("a"))).otherwise(F.struct("ka", "a"))
    o = cut(und.join(da, "a").join(db, "b").select(lo.alias("x"), hi.alias("y"), "w").select("x.a", F.struct("y.ka", "y.a").alias("y"), "w").toDF("x", "y", "w"))
    p, q = o.toDF("x", "y1", "w1"), o.toDF("x", "y2", "w2")
    wedges = p.join(q, "x").where("y1 < y2").select("x", F.col("y1.a").alias("u"), F.col("y2.a").alias("v"), "w1", "w2")
    close = o.select(F.col("x").alias("u"), F.col("y.a").alias("v"), F.col("w").alias("w3"))
    tri = wedges.join(close, ["u", "v"]).select(F.explode(F.array("x", "u", "v")).alias("node"), (F.lit(2) * F.col("w1") * F.col("w2") * F.col("w3")).alias("t"))
    t = tri.groupBy("node").agg(F.sum("t").alias("t"))
    half = und.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("d"), F.count(F.when(F.col("w") == 2, 1)).alias("r"))
    base = node_set(g).join(half, "node", "left").join(t, "node", "left")
    down = F.lit(2.0) * (F.col("d") * (F.col("d") - 1) - F.lit(2) * F.col("r"))
    return base.select("node", F.when(F.coalesce("t", F.lit(0)) > 0, F.col("t") / down).otherwise(F.lit(0.0)).alias("clustering"))


def average_neighbor_degree(edges: Edges) -> DataFrame:
    """(node, avg_neighbor_degree): mean out-degree of the successors, 0 without any."""
    g = as_graph(edges)
    e = g.edges
    out = e.groupBy(F.col("Source").alias("Target")).agg(F.count(F.lit(1)).alias("k"))
    per = e.join(out, "Target", "left").groupBy(F.col("Source").alias("node")).agg(F.avg(F.coalesce("k", F.lit(0))).alias("avg_neighbor_degree"))
    return node_set(g).join(per, "node", "left").fillna(0.0, ["avg_neighbor_degree"])


def katz(edges: Edges, alpha: float = 0.1, beta: float = 1.0, iterations: int | None = None, tol: float = 1e-6, max_iter: int = 1000) -> DataFrame:
    """(node, katz): x <- alpha * A'x + beta, L2-normalised (Katz, 1953).

    Runs ``iterations`` rounds, or until the L1 change is below tol * nodes; raises RuntimeError when that does not
    happen within ``max_iter`` rounds or values overflow, as alpha must be below 1 / largest eigenvalue.
    """
    g = as_graph(edges)
    n_df, (n,) = cut_counted(node_set(g))
    # kept by Source over the rounds, so that a round moves the vector and its sums, not the edges; a lost part is read again
    e = g.edges.repartition(_partitions(g.edges), "Source").persist(StorageLevel.DISK_ONLY)
    x, before = n_df.withColumn("x", F.lit(0.0)), None
    for i in range(iterations if iterations is not None else max_iter):
        got = e.join(x, e.Source == x.node).groupBy(F.col("Target").alias("node")).agg(F.sum("x").alias("s"))
        new = x.withColumnRenamed("x", "old").join(got, "node", "left") if iterations is None else n_df.join(got, "node", "left")
        new = new.withColumn("x", F.lit(alpha) * F.coalesce("s", F.lit(0.0)) + F.lit(beta)).drop("s")
        change = None
        if iterations is None or i % 4 == 3 or i == iterations - 1:
            # the plan must not grow with the rounds
            diff = [F.sum(F.abs(F.col("x") - F.col("old")))] if iterations is None else []
            new, (_, *change) = cut_counted(new, *diff)
            discard(before)
            before = new
        x = new.select("node", "x")
        if iterations is None:
            if change[0] is None or change[0] < tol * n:
                break
            if change[0] > 1e100:
                e.unpersist()
                raise RuntimeError("katz diverges: alpha is not below 1 / largest eigenvalue")
    else:
        if iterations is None:
            e.unpersist()
            raise RuntimeError(f"katz did not converge in {max_iter} rounds")
    e.unpersist()
    norm = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return x.join(F.broadcast(norm)).select("node", (F.col("x") / F.col("norm")).alias("katz"))  # one row


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bfs_counts(edges: Edges, roots: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(root, node, dist, paths): shortest distances from each root and the number of shortest paths, level by level.

    ``roots`` is (root); the root itself has distance 0 and one path. ``reverse`` follows edges backwards. The result has
    a row per reachable pair: bound the roots or the depth on large graphs. Graphs that a task can hold are searched by
    tasks with a share of the roots each.
    """
    g = as_graph(edges)
    e = g.edges
    if roots.schema["root"].dataType == e.schema["Source"].dataType and g.held is not None:
        return held.path_counts(g.held, roots, max_depth, reverse)
    e = e.select(F.col("Target").alias("f"), F.col("Source").alias("t")) if reverse else e.toDF("f", "t")
    seen = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("dist"), F.lit(1).cast("bigint").alias("paths")).distinct())
    front, depth, parts = seen, 0, [seen]
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(e, front.node == e.f).groupBy("root", F.col("t").alias("node")).agg(F.sum("paths").alias("paths"))
        front = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("dist"), "paths"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        parts.append(front)
        if depth % 8 == 0:
            seen = cut(seen)
            discard(*parts[:-1])  # the last level is searched from
            parts = [front, seen]
    return seen


def betweenness(edges: Edges, k: int | None = 10, seed: int = 42) -> DataFrame:
    """(node, betweenness) from k hashed pivots (Brandes, 2001), or from all nodes with k None.

    Directed, endpoints left out, scaled by 1 / ((n - 1)(n - 2)) and by n / k.
    """
    g = as_graph(edges)
    every, (n,) = cut_counted(node_set(g))
    roots = every.toDF("root")
    if k is not None and k < n:
        roots = roots.orderBy(key_hash(seed, "root"), "root").limit(k)
    roots = cut(roots)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if k is not None and k < n:
        scale *= n / k
    total = held.dependencies(g.held, roots) if g.held is not None else _dependencies(g, roots)
    got = total.groupBy("node").agg((F.sum("delta") * scale).alias("betweenness"))
    return every.join(got, "node", "left").fillna(0.0, ["betweenness"])


def _dependencies(g: Graph, roots: DataFrame) -> DataFrame:
    """(node, delta) of each root, level by level."""
    e = g.edges
    b, (_, depth) = cut_counted(bfs_counts(g, roots), F.max("dist"))
    depth = depth or 0
    # dependency of level d from level d + 1
    delta = cut(b.where(F.col("dist") == depth).select("root", "node", F.lit(0.0).alias("delta")))
    total = delta
    for d in range(depth - 1, 0, -1):
        up = b.where(F.col("dist") == d + 1).select("root", F.col("node").alias("w"), F.col("paths").alias("pw"))
        here = b.where(F.col("dist") == d).select("root", "node", "paths")
        via = e.join(up.join(delta.select("root", F.col("node").alias("w"), "delta"), ["root", "w"]), e.Target == F.col("w"))
        via = via.select("root", F.col("Source").alias("node"), "pw", "delta")
        part = here.join(via, ["root", "node"], "left").groupBy("root", "node").agg(
            F.coalesce(F.sum(F.col("paths") / F.col("pw") * (F.lit(1.0) + F.col("delta"))), F.lit(0.0)).alias("delta")
        )
        delta = cut(part)
        total = total.unionByName(delta)
    return total.where("root <> node")


def closeness(edges: Edges) -> DataFrame:
    """(node, closeness): inward distances, scaled by the share of nodes that reach it (Wasserman and Faust).

    All pairs by nature, counted without forming them where a task can hold the graph; else meant for graphs whose reachable
    pairs fit the cluster. ``closeness_estimates`` needs none.
    """
    g = as_graph(edges)
    s = cut(_reach_sums(g, reverse=True))
    n = s.count()
    c = F.when((F.col("d") > 0) & F.lit(n > 1), F.col("r") / F.col("d") * F.col("r") / F.lit(max(1, n - 1))).otherwise(F.lit(0.0))
    return s.select("node", c.alias("closeness"))


def reachable_count(edges: Edges) -> DataFrame:
    """(node, reachable): how many other nodes can be reached from each."""
    return _reach_sums(as_graph(edges)).select("node", F.col("r").alias("reachable"))


def _reach_sums(g: Graph, reverse: bool = False) -> DataFrame:
    """(node, r, d): how many other nodes each node reaches, and their summed distances; of the nodes that reach it with ``reverse``."""
    if g.held is not None:
        part = held.reach_sums(g.held, g.edges.sparkSession, g.edges.schema["Source"].dataType.simpleString(), reverse)
        return part.groupBy("node").agg(F.sum("r").alias("r"), F.sum("d").alias("d"))
    b = bfs_counts(g, node_set(g).toDF("root"), reverse=reverse)
    return b.groupBy(F.col("root").alias("node")).agg((F.count(F.lit(1)) - 1).alias("r"), F.sum("dist").alias("d"))


def reach_estimates(edges: Edges, reverse: bool = False, log_registers: int = 12, max_rounds: int = 1000) -> DataFrame:
    """(node, reached, distance_sum): about how many nodes each node reaches, itself included, and their summed distances.

    One mergeable sketch per node, which takes in the sketches of its successors round by round (HyperANF, Boldi, Rosa and
    Vigna, 2011): work per round follows the edges, whatever the number of reachable pairs. Tasks hold the graph and a slice of
    the registers (``sketch``); where the nodes are too many for that, sketches are written and joined. The standard error of
    ``reached`` is 1.04 / sqrt(2**log_registers), 1.6 % by default; small sets are counted exactly. Ends when no estimate grows;
    raises RuntimeError after ``max_rounds``. ``reverse`` follows edges backwards.
    """
    g = as_graph(edges)
    e = g.edges.select(F.col("Target").alias("f"), F.col("Source").alias("t")) if reverse else g.edges.toDF("f", "t")
    found = sketch.estimates(e, log_registers, max_rounds)
    return _joined_estimates(g, e, log_registers, max_rounds) if found is None else found


def _joined_estimates(g: Graph, e: DataFrame, log_registers: int, max_rounds: int) -> DataFrame:
    start = node_set(g).groupBy("node").agg(F.hll_sketch_agg(F.col("node").cast("string"), F.lit(log_registers)).alias("sk"))
    state = cut(start.select("node", "sk", F.lit(1).cast("bigint").alias("reached"), F.lit(0).cast("bigint").alias("distance_sum"), F.lit(True).alias("fresh")))
    for r in range(1, max_rounds + 1):
        fresh = state.where("fresh").select("node", "sk")  # what did not change has been taken in before
        sent = e.join(fresh, e.t == fresh.node).groupBy(F.col("f").alias("node")).agg(F.hll_union_agg("sk").alias("more"))
        both = state.withColumnRenamed("sk", "old").join(sent, "node", "left").withColumn("sk", F.when(F.col("more").isNull(), F.col("old")).otherwise(F.hll_union("old", "more")))
        now = F.greatest(F.hll_sketch_estimate("sk"), F.col("reached"))
        new = both.select("node", "sk", now.alias("reached"), (F.col("distance_sum") + F.lit(r) * (now - F.col("reached"))).alias("distance_sum"), (now - F.col("reached")).alias("grown"), (F.col("sk") != F.col("old")).alias("fresh"))
        new, (_, grown) = cut_counted(new, F.sum("grown"))
        discard(state)
        state = new
        if not grown:
            return state.select("node", "reached", "distance_sum")
    raise RuntimeError(f"estimates still grow after {max_rounds} rounds")


def closeness_estimates(edges: Edges, **kw) -> DataFrame:
    """(node, closeness) as ``closeness``, from sketches: for graphs whose reachable pairs are too many to form."""
    g = as_graph(edges)
    n = node_set(g).count()
    r, d = F.col("reached") - 1, F.col("distance_sum")
    c = F.when((d > 0) & F.lit(n > 1), r / d * r / F.lit(max(1, n - 1))).otherwise(F.lit(0.0))
    return reach_estimates(g, reverse=True, **kw).select("node", c.alias("closeness"))


def propflow(edges: DataFrame, roots: DataFrame, depth: int = 5, weight: str | None = None) -> DataFrame:
    """(root, mean_score): flow from each root over at most ``depth`` levels (Lichtenwalter et al., 2010).

    A node passes its score on once, when its level comes, in proportion to edge weights (1 by default); the mean is
    over all nodes with a score, the root's own score of 1 included.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e, (size,) = cut_counted(edges.where("Source is not null and Target is not null").groupBy("Source", "Target").agg(F.max(w).alias("w")))
    if size <= held.MAX_EDGES and roots.schema["root"].dataType == e.schema["Source"].dataType:
        return held.flow_means(*held.hold_weighted(e), roots, depth)
    share = e.groupBy("Source").agg(F.sum("w").alias("all_w"))
    e = cut(e.join(share, "Source").select(F.col("Source").alias("f"), F.col("Target").alias("t"), (F.col("w") / F.col("all_w")).alias("p")))
    score = cut(roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("score"), F.lit(0).alias("level")).distinct())
    for d in range(depth):
        flow = score.where(F.col("level") == d).join(e, F.col("node") == F.col("f")).select("root", F.col("t").alias("node"), (F.col("score") * F.col("p")).alias("score"), F.lit(d + 1).alias("level"))
        score = cut(score.unionByName(flow).groupBy("root", "node").agg(F.sum("score").alias("score"), F.min("level").alias("level")))
    return score.groupBy("root").agg(F.avg("score").alias("mean_score"))


def max_flow(edges: DataFrame, pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(Source, Target, max_flow): most edge-disjoint paths of each distinct pair, unit capacities; 0 between unlinked nodes.

    Where a task can hold the graph, each looks for augmenting paths of its share of the pairs by itself. Else shortest augmenting paths, one per pair and round, for all pairs side by side: a level-synchronous search of each
    pair's residual graph keeps one predecessor per node, and the path found flips its edges. A pair is done when its
    Target is out of reach. Rounds are at most the largest flow plus one; bound the pairs on large graphs. Source = Target
    gives null. Raises RuntimeError when pairs still have a path after ``max_rounds``.
    """
    g = as_graph(edges)
    ends = pairs.select("Source", "Target").where("Source is not null and Target is not null").distinct()
    k = ["Source", "Target"]
    live = cut(ends.where("Source <> Target"))
    if g.held is not None and {ends.schema[c].dataType for c in k} == {g.edges.schema["Source"].dataType}:
        flow, (_, most) = cut_counted(held.flows(g.held, live, max_rounds), F.max("f"))
        if most and most >= max_rounds:
            raise RuntimeError(f"max_flow has not ended within {max_rounds} rounds")
        return ends.join(flow, k, "left").select(*k, F.col("f").alias("max_flow"))
    e = cut(g.edges.where("Source <> Target").toDF("u", "v"))
    used = cut(live.select(*k, F.lit("").alias("u"), F.lit("").alias("v")).where("false"))
    flow = cut(live.withColumn("f", F.lit(0)))
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        seen = cut(live.select(*k, F.col("Source").alias("at"), F.lit(None).cast("string").alias("via"), F.lit(True).alias("fwd"), F.lit(0).alias("level")))
        front, depth, found = seen, 0, None
        while not front.isEmpty():
            depth += 1
            ahead = front.join(e, front["at"] == e["u"]).select(*k, F.col("u").alias("via"), F.col("v").alias("at"), F.lit(True).alias("fwd"))
            ahead = ahead.join(used.select(*k, F.col("u").alias("via"), F.col("v").alias("at")), [*k, "via", "at"], "left_anti").select(*k, "via", "at", "fwd")
            back = front.select(*k, F.col("at").alias("v")).join(used, [*k, "v"]).select(*k, F.col("v").alias("via"), F.col("u").alias("at"), F.lit(False).alias("fwd"))
            new = ahead.unionByName(back).join(seen.select(*k, "at"), [*k, "at"], "left_anti")
            new = new.groupBy(*k, "at").agg(F.min(F.struct("via", "fwd")).alias("p")).select(*k, "at", "p.via", "p.fwd", F.lit(depth).alias("level"))
            new = cut(new)
            hit = new.where(F.col("at") == F.col("Target")).select(*k)
            before = (found, seen, front)
            found = cut(hit if found is None else found.unionByName(hit))
            seen = cut(seen.unionByName(new))
            front = cut(new.join(found, k, "left_anti").select(*new.columns))
            discard(new, *before)
        # walk back from each Target
        at = found.withColumn("at", F.col("Target"))
        steps = None
        for _ in range(depth):
            s = cut(at.join(seen, [*k, "at"]).where("via is not null").select(*k, "via", "at", "fwd"))
            if s.isEmpty():
                break
            steps = s if steps is None else steps.unionByName(s)
            at = s.select(*k, F.col("via").alias("at"))
        if steps is None:
            live = found
            break
        add = steps.where("fwd").select(*k, F.col("via").alias("u"), F.col("at").alias("v"))
        drop = steps.where("not fwd").select(*k, F.col("at").alias("u"), F.col("via").alias("v"))
        before = (used, flow, seen, front)
        used = cut(used.join(drop, [*k, "u", "v"], "left_anti").select(*k, "u", "v").unionByName(add))
        flow = cut(flow.join(found.withColumn("one", F.lit(1)), k, "left").select(*k, (F.col("f") + F.coalesce("one", F.lit(0))).alias("f")))
        discard(live, *before)
        live = found
    if not live.isEmpty():
        raise RuntimeError(f"max_flow has not ended within {max_rounds} rounds")
    return ends.join(flow, k, "left").select(*k, F.col("f").cast("bigint").alias("max_flow"))
