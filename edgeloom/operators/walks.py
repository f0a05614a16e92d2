"""Random walks as joins: uniform, self-avoiding and second-order, all driven by seeded hashes.

Successors of a node are numbered, and a walk looks its next node up by number: a hub's neighbourhood is never expanded.
Walks travel as (walk_id, node, a few recent nodes); their nodes are written down in blocks and put together at the
end, so shuffled data and plans are linear in the length. Where a task can hold the graph, uniform and second-order walks are
made by tasks with a share of the nodes each (``held``), by the same hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.hashing import hash_int
from edgeloom.operators import graph, held, order
from edgeloom.session import cut, cut_counted, discard

CUT_EVERY = 4
TRIES = 4  # proposals of a walk per round of acceptance and rejection


def edge_index(edges: graph.Edges) -> DataFrame:
    """(Source, ix, k, Target, kt): successors of each node numbered from 0 in order, k of them; kt is Target's own k.

    Numbered by one global range sort, so a hub's successors need not meet in one task.
    """
    g = graph.as_graph(edges)
    e = cut(order.global_rank(g.edges, ["Source", "Target"], "rn"))
    first = e.groupBy("Source").agg(F.min("rn").alias("lo"), F.count(F.lit(1)).alias("k"))
    out = e.join(first, "Source").select("Source", (F.col("rn") - F.col("lo")).alias("ix"), "k", "Target")
    after = first.select(F.col("Source").alias("Target"), F.col("k").alias("kt"))
    return cut(out.join(after, "Target", "left").select("Source", "ix", "k", "Target", F.coalesce("kt", F.lit(0)).alias("kt")))


def pick_uniform(state: DataFrame, index: DataFrame, at: str, h: Column, name: str) -> DataFrame:
    """``state`` with a uniformly hashed successor of column ``at``; null at a dead end.

    Two equality joins, on the node and on (node, position): no adjacency list is ever built.
    """
    deg = index.where("ix = 0").select(F.col("Source").alias("__n"), F.col("k").alias("__k"))
    s = state.withColumn("__h", h).join(deg, F.col(at) == F.col("__n"), "left").withColumn("__i", F.pmod(F.col("__h"), F.col("__k")))
    to = index.select(F.col("Source").alias("__s"), F.col("ix").alias("__x"), F.col("Target").alias(name))
    out = s.join(to, (F.col(at) == F.col("__s")) & (F.col("__i") == F.col("__x")), "left")
    return out.select(*state.columns, name)


def _some(k: str) -> Column:
    """A count to divide by: null instead of 0."""
    return F.nullif(F.col(k), F.lit(0))


def _look_up(state: DataFrame, index: DataFrame, position: Column) -> DataFrame:
    """``state`` with (to, kt), the successor of ``at`` at ``position``; null where k is 0.

    Ended walks have no key that could gather them in one task: each gets one of its own.
    """
    key = F.when(F.col("k") > 0, F.col("at")).otherwise(F.concat(F.lit("\0"), F.col("walk_id")))
    s = state.withColumn("__a", key).withColumn("__i", F.when(F.col("k") > 0, position).otherwise(F.lit(0)))
    to = index.select(F.col("Source").alias("__a"), F.col("ix").alias("__i"), F.col("Target").alias("to"), "kt")
    return s.join(to, ["__a", "__i"], "left").drop("__a", "__i")


def _walk(edges: graph.Edges, length: int, num_walks: int, seed: int, move: Callable, whole: bool = False) -> DataFrame:
    """(walk_id, walk). ``move(state, index, step)`` adds (to, kt); ``whole`` keeps all nodes of a walk at hand in ``part``."""
    g = graph.as_graph(edges)
    n = int(g.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = edge_index(g)
    # kept by key over the steps; a lost part is read again
    index = raw.repartition(n, "Source", "ix").persist(StorageLevel.DISK_ONLY)
    no = F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("no")
    state = g.degrees.select("node", F.col("out_degree").alias("k"), no).select(
        F.concat_ws("#", "node", "no").alias("walk_id"), F.col("node").cast("string").alias("at"), "k", F.lit(None).cast("string").alias("prev"),
        F.array(F.col("node").cast("string")).alias("part"),
    )
    blocks: list[DataFrame] = []
    for step in range(1, length):
        moved = move(state, index, step)
        went = F.col("to").isNotNull()
        state = moved.select(
            "walk_id", F.col("to").alias("at"), F.when(went, F.col("kt")).otherwise(0).alias("k"), F.when(went, F.col("at")).alias("prev"),
            F.when(went, F.concat("part", F.array("to"))).otherwise(F.col("part")).alias("part"),
        )
        if step % CUT_EVERY == 0 and step < length - 1:
            state, (_, live) = cut_counted(state, F.count("at"))
            if not whole:
                blocks.append(state.select("walk_id", F.lit(step).alias("block"), "part"))
                state = state.where("at is not null").withColumn("part", F.array().cast("array<string>"))
            if not live:
                break
    blocks.append(state.select("walk_id", F.lit(length).alias("block"), "part"))
    if len(blocks) == 1:
        out = cut(blocks[0].select("walk_id", F.col("part").alias("walk")))
    else:
        every = blocks[0]
        for b in blocks[1:]:
            every = every.unionByName(b)
        per = every.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("b"))  # length nodes
        out = cut(per.select("walk_id", F.flatten(F.col("b.part")).alias("walk")))
    index.unpersist()
    discard(raw)
    return out


def uniform_walks(edges: graph.Edges, walk_length: int = 80, num_walks: int = 10, seed: int = 42) -> DataFrame:
    """(walk_id, walk): ``num_walks`` walks of at most ``walk_length`` nodes from every node; they end at dead ends.

    walk_id is node#number; step k of a walk takes successor number H(walk_id, k) mod out-degree. Nodes are strings.
    """
    g = graph.as_graph(edges)
    if g.held is not None and num_walks > 0:
        return held.walks(g.held, g.edges.sparkSession, walk_length, num_walks, held.uniform_step(seed))
    return _walk(g, walk_length, num_walks, seed, lambda s, index, k: _look_up(s, index, F.pmod(hash_int(seed, "walk_id", F.lit(k)), _some("k"))))


def self_avoiding_walks(edges: graph.Edges, path_length: int = 10, n_walks: int = 5, seed: int = 42) -> DataFrame:
    """(walk_id, walk): like uniform walks, but never to a visited node; a walk ends when none is left.

    Of the r successors not visited, in order, step k takes number H(walk_id, k) mod r. The visited ones among the successors are
    found by looking up the walk's own nodes, and their positions skipped.
    """

    kept: list[DataFrame] = []

    def move(s: DataFrame, index: DataFrame, k: int) -> DataFrame:
        s = cut(s)  # read twice
        discard(*kept)
        kept[:] = [s]
        seen = s.where("k > 0").select("walk_id", F.col("at").alias("Source"), F.explode("part").alias("Target"))
        taken = seen.join(index.select("Source", "Target", "ix"), ["Source", "Target"]).groupBy("walk_id").agg(F.array_sort(F.collect_list("ix")).alias("taken"))  # path_length at most
        s = s.join(taken, "walk_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>")))
        s = s.withColumn("free", F.col("k") - F.size("taken")).withColumn("k", F.when(F.col("free") > 0, F.col("k")).otherwise(0))
        nth = F.pmod(hash_int(seed, "walk_id", F.lit(k)), _some("free"))
        position = F.aggregate("taken", nth, lambda at, t: at + (t <= at).cast("bigint"))
        return _look_up(s, index, position)

    return _walk(edges, path_length, n_walks, seed, move, whole=True)


def node2vec_walks(edges: graph.Edges, walk_length: int = 80, num_walks: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """(walk_id, walk): second-order walks (Grover and Leskovec, 2016).

    The weight of a successor is 1/p if it is the node before, 1 if the node before has an edge to it, else 1/q. With p = q = 1
    these are uniform walks. Else a successor is proposed by number and accepted with its weight over the largest of 1 and 1/q;
    what the node before weighs beyond that is an area of its own (KnightKing, Yang et al., 2019). Try j of step k uses
    H(walk_id, k, j, .); walks that reject all TRIES go round again.
    """
    if p == 1 and q == 1:
        return uniform_walks(edges, walk_length, num_walks, seed)
    g = graph.as_graph(edges)
    if g.held is not None and num_walks > 0:
        return held.walks(g.held, g.edges.sparkSession, walk_length, num_walks, held.second_order_step(p, q, seed))
    top = max(1.0, 1.0 / q)
    beyond = max(0.0, 1.0 / p - top)
    unit = F.lit(float(1 << 32))
    links = g.edges.select(F.col("Source").cast("string").alias("from"), F.col("Target").cast("string").alias("to"))
    kept: list[DataFrame] = []

    def move(s: DataFrame, index: DataFrame, k: int) -> DataFrame:
        back = links.select(F.col("from").alias("at"), F.col("to").alias("prev"), F.lit(True).alias("back"))
        s = s.join(back, ["at", "prev"], "left").select(*s.columns, F.when(F.col("back"), F.lit(beyond)).otherwise(F.lit(0.0)).alias("extra"))
        open_, done, first = cut(s), None, 0
        discard(*kept)
        kept[:] = [open_]
        while True:
            tries = open_.withColumn("j", F.explode(F.sequence(F.lit(first), F.lit(first + TRIES - 1))))
            h = lambda tag: hash_int(seed, "walk_id", F.lit(k), "j", F.lit(tag))
            own = (h("area") / unit < F.col("extra") / (_some("k") * F.lit(top) + F.col("extra"))) & (F.col("extra") > 0)
            tries = _look_up(tries, index, F.pmod(h("at"), _some("k"))).withColumn("own", F.coalesce(own, F.lit(False)))
            near = links.select(F.col("from").alias("prev"), "to", F.lit(True).alias("near"))
            tries = tries.join(near, ["prev", "to"], "left")
            weight = F.when(F.col("to") == F.col("prev"), min(1.0 / p, top)).when(F.col("near"), 1.0).otherwise(1.0 / q)
            weight = F.when(F.col("prev").isNull(), F.lit(top)).otherwise(weight)
            good = F.col("own") | (F.col("k") == 0) | (h("accept") / unit < weight / F.lit(top))
            node = F.when(F.col("own"), F.col("prev")).otherwise(F.col("to"))
            best = tries.where(good).groupBy("walk_id").agg(F.min(F.struct("j", node.alias("to"), F.when(~F.col("own"), F.col("kt")).alias("kt"))).alias("b"))
            got, (_, missing) = cut_counted(open_.join(best, "walk_id", "left"), F.count(F.when(F.col("b").isNull(), 1)))
            kept.append(got)
            mine = got.where("b is not null").select(*open_.columns, "b.to", "b.kt")
            done = mine if done is None else done.unionByName(mine)
            if not missing:
                break
            open_, first = got.where("b is null").drop("b"), first + TRIES
        # a step back to the node before: its number of successors
        known = g.degrees.select(F.col("node").cast("string").alias("to"), F.col("out_degree").alias("k2"))
        back_too = done.where("kt is null and to is not null").join(known, "to", "left").withColumn("kt", F.col("k2")).select(*done.columns)
        return done.where("kt is not null or to is null").unionByName(back_too)

    return _walk(g, walk_length, num_walks, seed, move)


def length_histogram(walks: DataFrame) -> DataFrame:
    """(length, walks)."""
    return walks.groupBy(F.size("walk").alias("length")).agg(F.count(F.lit(1)).alias("walks"))


def average_length(walks: DataFrame) -> DataFrame:
    return walks.agg(F.round(F.avg(F.size("walk")), 6).alias("avg_length"))
