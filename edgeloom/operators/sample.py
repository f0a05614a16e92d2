"""Seeded samplers of edges and of non-edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.hashing import hash_int
from edgeloom.operators import graph, order, walks
from edgeloom.operators.split import KEY, nodes
from edgeloom.session import cut, cut_counted, discard, written


def sample_time(edges: DataFrame, size: int) -> DataFrame:
    """The first ``size`` edges by (Date, Source, Target); null dates last."""
    return order.prefix(edges, n=size, **order.by_time("Date", *KEY))


def sample_random(edges: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``size`` edges in the order of a seeded hash."""
    return order.prefix(edges, n=size, **order.by_hash(seed, *KEY))


def sample_node(edges: DataFrame, size: int, seed: int = 42, batch: int = 1000) -> DataFrame:
    """All out-edges of hashed batches of ``batch`` nodes, until at least ``size`` edges are reached.

    Takes every edge when the graph has fewer than ``size``.
    """
    edges = written(edges)
    e = cut(graph.digraph(edges))
    ranked = order.global_rank(cut(nodes(e)), order.shuffled(seed, "node"), "rn").withColumn("batch", F.floor((F.col("rn") - 1) / batch))
    out = e.groupBy(F.col("Source").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    ranked = cut(ranked.join(out, "node", "left").fillna(0, ["k"]))
    sums = ranked.groupBy("batch").agg(F.sum("k").alias("k"))
    # one number per batch of nodes; running totals over batches, cut at the batch that reaches the size
    before = order.global_rank(sums, ["batch"], "rn")
    totals = order.running_total(before, "k")
    last = totals.where(F.col("total") - F.col("k") < size).select("batch")
    chosen = ranked.join(last, "batch", "left_semi").select(F.col("node").alias("Source"))
    return edges.join(chosen, "Source", "left_semi").select(*edges.columns)


def sample_traverse(edges: DataFrame, size: int, method: str = "bfs", seed: int = 42) -> DataFrame:
    """Two-hop stars of hashed roots until at least ``size`` edges: out-edges of a root, then of its successors.

    The expansion order is (root rank, hop, node), for dfs with the successors of a root in descending order; an edge
    counts where it is first met; whole node expansions are taken, the last one reaching ``size``. As many roots are
    unfolded as the size needs, doubling from a first guess.
    """
    if method not in ("bfs", "dfs"):
        raise ValueError(f"unknown traversal {method!r}")
    edges = written(edges)
    e, (n_edges,) = cut_counted(graph.digraph(edges))
    ranked, (n_nodes,) = cut_counted(order.global_rank(cut(nodes(e)), order.shuffled(seed, "node"), "root_rank"))
    roots = max(1, min(n_nodes, 2 * size * n_nodes // max(1, n_edges)))
    while True:
        r = ranked.where(F.col("root_rank") <= roots).select("root_rank", F.col("node").alias("at"))
        hop1 = r.withColumn("hop", F.lit(0)).join(e, F.col("at") == F.col("Source"))
        hop2 = hop1.where("Source <> Target").select("root_rank", F.lit(1).alias("hop"), F.col("Target").alias("at")).join(e, F.col("at") == F.col("Source"))
        steps = hop1.select("root_rank", "hop", "at", *KEY).unionByName(hop2.select("root_rank", "hop", "at", *KEY))
        key = F.struct("root_rank", "hop", (F.col("at") if method == "bfs" else F.translate("at", "0123456789", "9876543210")).alias("o"), "at")
        first = cut(steps.groupBy(*KEY).agg(F.min(key).alias("step")))
        if roots >= n_nodes or first.count() >= size:
            break
        roots = min(n_nodes, roots * 2)
    per = first.groupBy("step").agg(F.count(F.lit(1)).alias("k"))
    totals = order.running_total(order.global_rank(per, ["step"], "rn"), "k")
    keep = totals.where(F.col("total") - F.col("k") < size).select("step")
    chosen = first.join(keep, "step", "left_semi").select(*KEY)
    return edges.join(chosen, KEY, "left_semi").select(*edges.columns)


DFS_LIMIT = 20_000_000  # edges that one task may hold


def sample_search(edges: DataFrame, size: int, method: str = "bfs", seed: int = 42, limit: int = DFS_LIMIT) -> DataFrame:
    """True traversal: all out-edges of visited nodes until at least ``size`` edges, restarted at hashed nodes.

    bfs goes level by level; the last level is taken node by node, by id, up to the node that reaches the size. When
    nothing new can be reached it starts again from the next hashed nodes, twice as many each time, side by side. dfs is
    sequential by nature: one task walks the graph, successors in descending order, each restart from the next hashed
    node; more than ``limit`` edges raise ValueError. A graph of at most ``size`` edges comes back whole.
    """
    if method not in ("bfs", "dfs"):
        raise ValueError(f"unknown traversal {method!r}")
    edges = written(edges)
    e, (n_edges,) = cut_counted(graph.digraph(edges))
    if n_edges <= size:
        return edges.join(e, KEY, "left_semi").select(*edges.columns)
    if size <= 0:
        return edges.where("false")
    if method == "dfs":
        if n_edges > limit:
            raise ValueError(f"dfs is meant for at most {limit} edges")
        chosen = _depth_first(e, size, seed)
    else:
        chosen = _breadth_first(e, size, seed)
    return edges.join(chosen.select(F.col("node").alias("Source")), "Source", "left_semi").select(*edges.columns)


def _breadth_first(e: DataFrame, size: int, seed: int) -> DataFrame:
    ranked, (n_nodes,) = cut_counted(order.global_rank(cut(nodes(e)), order.shuffled(seed, "node"), "rn"))
    out = cut(e.groupBy(F.col("Source").alias("node")).agg(F.count(F.lit(1)).alias("k")))
    visited, reached, roots, next_root = None, 0, 1, 1
    frontier = ranked.where("rn = 1").select("node")
    while True:
        level, (found, k) = cut_counted(frontier.join(out, "node", "left").fillna(0, ["k"]), F.sum("k"))
        k = k or 0
        if reached + k >= size:
            totals = order.running_total(order.global_rank(level, ["node"], "rn"), "k")
            last = totals.where(F.col("total") - F.col("k") < size - reached).select("node")
            return last if visited is None else visited.unionByName(last)
        reached += k
        if found:
            seen = level.select("node") if visited is None else visited.unionByName(level.select("node"))
            known, visited = visited, cut(seen)
            discard(known)
            met = level.select(F.col("node").alias("Source")).join(e, "Source").select(F.col("Target").alias("node")).distinct()
            frontier, (more,) = cut_counted(met.join(visited, "node", "left_anti"))
            if more:
                continue
        next_root, roots = next_root + roots, min(2 * roots, n_nodes)
        fresh = ranked.where(F.col("rn").between(next_root, next_root + roots - 1)).select("node")
        frontier = fresh.join(visited, "node", "left_anti")


def _depth_first(e: DataFrame, size: int, seed: int) -> DataFrame:
    kind = e.schema["Source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after: dict = {}
        every: dict = {}
        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                after.setdefault(s, []).append(t)
                every[s] = every[t] = None
        roots = sorted(every, key=lambda n: (md5(f"{seed}|{n}".encode()).hexdigest(), n))
        seen: dict = {}
        got = 0
        for r in roots:
            stack = [r]
            while stack and got < size:
                n = stack.pop()
                if n in seen:
                    continue
                seen[n] = None
                got += len(after.get(n, ()))
                stack += [t for t in sorted(after.get(n, ())) if t not in seen]
            if got >= size:
                break
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), b.schema.field(0).type)], ["node"])

    return cut(e.coalesce(1).mapInArrow(run, f"node {kind}"))


def sample_walk(edges: DataFrame, size: int, seed: int = 42, restart: float = 0.15, walkers: int | None = None, max_steps: int = 1000, dead_ends: int = 100) -> DataFrame:
    """Random walks with restart until ``size`` distinct edges are met, the first ones by (step, walker).

    Hashed walkers run side by side, one for 16 wanted edges and 64 at least. Each returns to its start at a dead end;
    after a move with probability ``restart``, and after ``dead_ends`` dead ends, it takes a new hashed start among the nodes with
    successors. Gives all edges when there are at most ``size``; raises RuntimeError when ``size`` is not met within
    ``max_steps``.
    """
    e = cut(graph.digraph(edges))
    if e.count() <= size:
        return edges.join(e, KEY, "left_semi").select(*edges.columns)
    walkers = walkers or max(64, -(-size // 16))
    index = walks.edge_index(e)
    starts = cut(order.global_rank(e.select("Source").distinct(), order.shuffled(seed, "Source"), "rn").select(F.col("rn").alias("draw"), F.col("Source").alias("drawn")))
    n = F.lit(starts.count())
    state = e.sparkSession.range(1, walkers + 1).select(F.col("id").alias("walker"), (F.pmod(F.col("id") - 1, n) + 1).alias("draw")).join(starts, "draw")
    state = cut(state.select("walker", F.col("drawn").alias("start"), F.col("drawn").alias("at"), F.lit(0).alias("dead")))
    first: DataFrame | None = None
    recent: list[DataFrame] = []
    steps: list[DataFrame] = []
    for step in range(max_steps):
        moved = walks.pick_uniform(state, index, "at", hash_int(seed, "walker", F.lit(step)), "to")
        dead = F.col("dead") + F.when(F.col("to").isNull(), 1).otherwise(0)
        u = hash_int(seed, "walker", F.lit(step), F.lit("r")) / F.lit(float(1 << 32))
        moved = moved.withColumn("dead", dead).withColumn("new", (F.col("to").isNotNull() & (u < restart)) | (F.col("dead") == dead_ends))
        moved = moved.withColumn("draw", F.pmod(hash_int(seed, "walker", F.lit(step), F.lit("s")), n) + 1).join(starts, "draw")
        moved = cut(moved.select("walker", "start", "at", "to", "dead", "new", "drawn"))
        steps.append(moved)
        recent.append(moved.where("to is not null").select("at", "to", F.lit(step).alias("step"), "walker").toDF(*KEY, "step", "walker"))
        state = moved.select(
            "walker", F.when(F.col("new"), F.col("drawn")).otherwise(F.col("start")).alias("start"),
            F.when(F.col("new"), F.col("drawn")).otherwise(F.coalesce("to", "start")).alias("at"), F.when(F.col("dead") == dead_ends, 0).otherwise(F.col("dead")).alias("dead"),
        )
        if step % 10 == 9 or step == max_steps - 1:
            met = reduce(DataFrame.unionByName, recent).groupBy(*KEY).agg(F.min(F.struct("step", "walker")).alias("o"))
            known = first
            first, (n_met,) = cut_counted(met if first is None else first.unionByName(met).groupBy(*KEY).agg(F.min("o").alias("o")))
            discard(known, *steps[:-1])  # the last step is the walkers' state
            recent, steps = [], steps[-1:]
            if n_met >= size:
                chosen = order.prefix(first, ["o"], size).select(*KEY)
                return edges.join(chosen, KEY, "left_semi").select(*edges.columns)
    raise RuntimeError(f"random walks met fewer than {size} distinct edges within {max_steps} steps")


def sample_graph(edges: DataFrame, size: int, sampling: str, seed: int = 42) -> DataFrame:
    """Dispatch by name: time, random, node, bfs, dfs, rw; any other name returns the edges unsampled."""
    if sampling == "time":
        return sample_time(edges, size)
    if sampling == "random":
        return sample_random(edges, size, seed)
    if sampling == "node":
        return sample_node(edges, size, seed)
    if sampling in ("bfs", "dfs"):
        return sample_traverse(edges, size, sampling, seed)
    if sampling == "rw":
        return sample_walk(edges, size, seed)
    return edges


def node_index(edges: DataFrame) -> DataFrame:
    """(node, ix): nodes in order, from 0."""
    return order.global_rank(written(nodes(edges)), ["node"], "ix").withColumn("ix", F.col("ix") - 1)


def negative_edges(train: DataFrame, draws: int, *known: DataFrame, seed: int = 42, tag: str = "") -> DataFrame:
    """Non-edges (Date null, Class 0) among ``draws`` hashed pairs of train nodes.

    Self-pairs, repeats and every pair of ``known`` are rejected, so there are at most ``draws``. Draw i takes nodes
    H('s', i) mod N and H('t', i) mod N of the sorted node list.
    """
    spark = train.sparkSession
    train = written(train)
    ix, (n,) = cut_counted(node_index(train))
    if not n:
        kind = train.schema["Source"].dataType.simpleString()
        return spark.createDataFrame([], f"Date timestamp_ntz, Source {kind}, Target {kind}, Class int")
    d = spark.range(draws).select(
        F.pmod(hash_int(seed, F.lit(f"{tag}s"), "id"), F.lit(n)).alias("si"), F.pmod(hash_int(seed, F.lit(f"{tag}t"), "id"), F.lit(n)).alias("ti")
    )
    d = d.where("si <> ti").distinct()
    out = d.join(ix.toDF("Source", "si"), "si").join(ix.toDF("Target", "ti"), "ti").select(*KEY)
    for k in known:
        out = out.join(k.select(*KEY).distinct(), KEY, "left_anti")
    return out.select(F.lit(None).cast("timestamp_ntz").alias("Date"), *KEY, F.lit(0).alias("Class"))


def negative_train(train: DataFrame, test: DataFrame, seed: int = 42) -> DataFrame:
    """As many draws as train rows, positives of train and test rejected."""
    train = written(train)
    return negative_edges(train, train.count(), train, test, seed=seed)


def negative_test(train: DataFrame, test: DataFrame, train_negatives: DataFrame, seed: int = 42) -> DataFrame:
    """As many draws as test rows, also rejecting the train frame's negatives."""
    train, test = written(train), written(test)
    return negative_edges(train, test.count(), train, test, train_negatives, seed=seed, tag="test-")


def with_negatives(train: DataFrame, test: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Both frames with their negatives appended."""
    cols = ["Date", *KEY, "Class"]
    # both are read several times
    train, test = cut(train.select(*cols)), cut(test.select(*cols))
    nt = cut(negative_train(train, test, seed))
    ns = negative_test(train, test, nt, seed)
    # no date, of whatever type the dates are
    nt, ns = (n.withColumn("Date", F.lit(None).cast(e.schema["Date"].dataType)) for n, e in ((nt, train), (ns, test)))
    return train.unionByName(nt), test.unionByName(ns)


def negative_corrupt(edges: DataFrame, seed: int = 42) -> DataFrame:
    """One candidate per edge: every second edge by hash keeps its Source, the others their Target; the other end is drawn.

    Self-pairs, repeats and existing edges are rejected.
    """
    e = cut(graph.digraph(edges))
    ix, (n,) = cut_counted(node_index(e))
    n = max(1, n)
    keep_source = F.pmod(hash_int(seed, F.lit("side"), *KEY), F.lit(2)) == 0
    d = e.select(*KEY, keep_source.alias("ks"), F.pmod(hash_int(seed, F.lit("node"), *KEY), F.lit(n)).alias("ix")).join(ix, "ix")
    d = d.select(F.when(F.col("ks"), F.col("Source")).otherwise(F.col("node")).alias("Source"), F.when(F.col("ks"), F.col("node")).otherwise(F.col("Target")).alias("Target"))
    d = d.where("Source <> Target").distinct().join(e, KEY, "left_anti")
    return d.select(F.lit(None).cast("timestamp_ntz").alias("Date"), *KEY, F.lit(0).alias("Class"))


