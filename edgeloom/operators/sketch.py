"""How far nodes reach, estimated in slices of registers by tasks that hold the graph's inner edges.

A sketch has some 2**log_registers registers, in groups of WIDTH. A group counts the nodes that are hashed into it, alone: its registers travel
against the edges, round by round, in memory, and leave two sums per node, so no sketch is ever written or sent. The groups' counts add up
(Ertl, 2017); small groups count a little worse, hence some registers more (MORE). Nodes that lead nowhere are one element each,
and nodes that none leads to are counted without being kept: only what lies between has rows of registers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.order import global_rank
from edgeloom.session import cut, cut_counted, discard

WIDTH = 128  # registers of a group
MAX_CELLS = 100_000_000  # registers of a group's rows, a byte each, that a task holds twice; with more nodes groups are narrower
MORE = {128: 1.03, 64: 1.03, 32: 1.06, 16: 1.14, 8: 1.3}  # registers by the width of a group, for an error of 1.04 / sqrt(2 ** log_registers)
SMALL = 512  # up to so many reached nodes are counted, not estimated
ROWS = 4096  # nodes taken at once
DEEP = 32  # successors of a node that are taken one rank at a time, for many nodes at once
EDGES = 1 << 15  # of a node with more successors, taken at once
UNIT = 256  # parts of a node in which estimates are kept, so that their sums do not depend on an order
CELLS = 1_000_000  # (root, node) pairs open at once where small sets are counted


def estimates(e: DataFrame, log_registers: int, max_rounds: int) -> DataFrame | None:
    """(node, reached, distance_sum) of ``graph.reach_estimates`` for distinct edges (f, t), f taking in t; None if rows would not fit a task."""
    spark = e.sparkSession
    ends = e.select(F.col("f").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("t").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    kinds = ends.groupBy("node").agg(F.when(F.max("o") == 0, 2).when(F.max("i") == 0, 1).otherwise(0).alias("kind"))
    kinds, counts = cut_counted(kinds, *[F.count(F.when(F.col("kind") == k, 1)) for k in (0, 1)])
    n, core, inner = counts[0], counts[1], counts[1] + counts[2]
    width = max(8, min(WIDTH, 1 << log_registers))
    while core * width > MAX_CELLS and width > 16:
        width //= 2
    if core * width > MAX_CELLS:
        discard(kinds)
        return None
    groups = ceil(MORE[width] * (1 << log_registers) / width)
    text = F.col("node").cast("string")
    register, zeros = F.pmod(F.xxhash64(text), F.lit(groups * width)), F.lit(65) - F.length(F.bin(F.xxhash64(text, F.lit("rank"))))
    ids = global_rank(kinds, ["kind", "node"]).select(
        "node", (F.col("rn") - 1).cast("int").alias("x"), F.floor(register / width).cast("int").alias("grp"), (F.pmod(register, F.lit(width)) * 128 + zeros).cast("int").alias("at")
    )
    ids = cut(ids)
    discard(kinds)
    there = ids.select(F.col("node").alias("t"), F.col("x").alias("b"), "grp", "at")
    linked = cut(e.join(ids.select(F.col("node").alias("f"), F.col("x").alias("a")), "f").join(there, "t").select("a", "b", "grp", "at"))
    edges = linked.where(F.col("b") < core).select("a", "b", F.lit(-1).alias("grp"))
    seeds = linked.where(F.col("b") >= inner).select("a", F.col("at").alias("b"), "grp", F.lit(1).alias("round"))
    seeds = seeds.unionByName(ids.where(F.col("x") < inner).select(F.col("x").alias("a"), F.col("at").alias("b"), "grp", F.lit(0).alias("round")))
    # the round in the sign: at 0 a node holds itself, at 1 what leads nowhere
    seeds = cut(seeds.select("a", F.when(F.col("round") == 0, F.col("b")).otherwise(-1 - F.col("b")).alias("b"), "grp").repartitionByRange("grp").sortWithinPartitions("grp"))
    tasks = max(1, min(groups, spark.sparkContext.defaultParallelism))
    bounds = [groups * i // tasks for i in range(tasks + 1)]
    inputs = [edges.unionByName(seeds.where(F.col("grp").between(lo, hi - 1))).coalesce(1) for lo, hi in zip(bounds, bounds[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), (x, code, grp) = _inputs(batches)
        if not len(a) and not len(x):
            return
        h = _Inner(a, b, core, inner)
        del a, b
        mine = [(x[grp == g], code[grp == g]) for g in np.unique(grp)]
        far, total, rounds = np.zeros(inner, np.int64), np.zeros(inner, np.int64), 0
        for x, code in mine:
            rounds = max(rounds, _search(h, x, code, width, far, total, max_rounds))
        for lo in range(0, inner, 100_000):
            own = h.place[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(own), dtype=np.int32)), pa.array(far[own]), pa.array(total[own]), pa.array(np.full(len(own), rounds, np.int32))], ["x", "far", "total", "rounds"])

    part = _together(inputs, edges.where("a < 0")).mapInArrow(run, "x int, far bigint, total bigint, rounds int").groupBy("x").agg(F.sum("far").alias("far"), F.sum("total").alias("total"), F.max("rounds").alias("rounds"))
    part, (_, rounds) = cut_counted(part.select("x", F.greatest(F.lit(1), F.round(F.col("far") / UNIT)).cast("bigint").alias("reached"), F.round(F.col("total") / UNIT).cast("bigint").alias("distance_sum"), "rounds"), F.max("rounds"))
    discard(seeds)
    if (rounds or 0) >= max_rounds:
        discard(part, ids, linked)
        raise RuntimeError(f"estimates still grow after {max_rounds} rounds")
    exact = _small(linked, part, inner).select("x", F.col("reached").alias("r"), F.col("distance_sum").alias("d"))
    discard(linked)
    found = ids.select("node", "x").join(part.drop("rounds"), "x", "left").join(exact, "x", "left")
    return found.select("node", F.coalesce("r", "reached", F.lit(1)).cast("bigint").alias("reached"), F.coalesce("d", "distance_sum", F.lit(0)).cast("bigint").alias("distance_sum"))


def _together(inputs: list[DataFrame], none: DataFrame) -> DataFrame:
    """A task for each of the inputs. Those of one partition alone would be put into one again, so a few without rows come along."""
    return reduce(DataFrame.unionAll, [*inputs, none])


def _inputs(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The edges (a, b) and the other rows (a, b, grp), copied from each batch so that none is kept."""
    edges: list[list[np.ndarray]] = [[], []]
    others: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        inside = columns[2] < 0
        for to, where in ((edges, inside), (others, ~inside)):
            for parts, c in zip(to, columns, strict=False):
                parts.append(c[where])

    def one(parts: list[np.ndarray]) -> np.ndarray:
        out = np.concatenate(parts) if parts else np.empty(0, np.int32)
        parts.clear()
        return out

    return [one(p) for p in edges], [one(p) for p in others]


class _Inner:
    """The edges into nodes 0 .. core - 1 from nodes 0 .. inner - 1, renumbered so that in both kinds, below ``core`` and above, degrees fall.

    place: the new number of each node. The successors of i are to[at[i]:at[i + 1]].
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, core: int, inner: int) -> None:
        deg = np.bincount(a, minlength=inner)
        order = np.concatenate([np.argsort(-deg[:core], kind="stable"), core + np.argsort(-deg[core:], kind="stable")])
        self.core, self.inner = core, inner
        self.place = np.empty(inner, np.int32)
        self.place[order] = np.arange(inner)
        self.deg = deg[order]
        self.at = np.concatenate([[0], np.cumsum(self.deg)])
        key = self.place[a] * np.int64(max(1, core))
        key += self.place[b]
        key.sort()
        key %= max(1, core)
        self.to = key.astype(np.int32)
        self.linked = np.flatnonzero(self.deg)


def _union(rows: np.ndarray, h: _Inner, v: np.ndarray) -> np.ndarray:
    """The largest registers among the successors of each of v, whose degrees fall and are not 0."""
    first, deg = h.at[v], h.deg[v]
    out = np.take(rows, h.to[first], axis=0)
    deep = int(np.searchsorted(-deg, -DEEP))
    for i in range(deep):
        for x in range(first[i], first[i] + deg[i], EDGES):
            np.maximum(out[i], np.take(rows, h.to[x : min(x + EDGES, first[i] + deg[i])], axis=0).max(0), out=out[i])
    rest, first, fall = out[deep:], first[deep:], -deg[deep:]
    for j in range(1, -fall[0] if len(fall) else 0):
        m = int(np.searchsorted(fall, -j))
        np.maximum(rest[:m], np.take(rows, h.to[first[:m] + j], axis=0), out=rest[:m])
    return out


def _sigma(x: float) -> float:
    if x == 1:
        return inf
    y, before, z = 1.0, -1.0, x
    while z != before:
        x, before = x * x, z
        z, y = z + x * y, 2 * y
    return z


class _Counter:
    """Elements behind each row of registers, in parts of UNIT (Ertl's improved raw estimate)."""

    def __init__(self, width: int) -> None:
        self.empty = np.array([width * _sigma(i / width) - i for i in range(width + 1)])
        self.scale = UNIT * width * width / (2 * log(2))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        exponent = np.subtract(127, rows, dtype=np.int32)
        exponent <<= 23
        z = exponent.view(np.float32).sum(1).astype(np.float64)  # of 2 ** -register
        if not rows.all():
            z += self.empty[np.add.reduce(rows == 0, axis=1, dtype=np.intp)]
        return np.rint(self.scale / z).astype(np.int64)


def _search(h: _Inner, x: np.ndarray, code: np.ndarray, width: int, far: np.ndarray, total: np.ndarray, max_rounds: int) -> int:
    """Adds the counts of a group and their summed distances to far and total; the number of rounds that changed something."""
    count = _Counter(width)
    self_ = code >= 0
    x, code = h.place[x], np.where(self_, code, -1 - code)
    slot, rank = code // 128, (code % 128).astype(np.uint8)
    by = np.argsort(x, kind="stable")
    rows = np.zeros((h.core, width), np.uint8)
    new = rows.copy()
    own = np.flatnonzero(self_ & (x < h.core))
    rows[x[own], slot[own]] = new[x[own], slot[own]] = rank[own]
    last = np.zeros(h.inner, np.int64)
    start = np.flatnonzero(self_)
    one = np.zeros((len(start), width), np.uint8)
    one[np.arange(len(start)), slot[start]] = rank[start]
    last[x[start]] = count(one)
    sx, slot, rank = x[by], slot[by], rank[by]
    changed = np.zeros(h.core, bool)
    changed[x[own]] = True
    full = np.unique(np.concatenate([h.linked, sx]))
    depth = 0
    while depth < max_rounds:
        depth += 1
        if changed.mean() > 0.25 if h.core else False:
            todo = full
        else:
            hit = np.zeros(h.inner, bool)
            if len(h.to):
                hit[h.linked] = np.logical_or.reduceat(changed[h.to], h.at[h.linked])
            if depth == 1:
                hit[sx] = True
            todo = np.flatnonzero(hit)
        changed = np.zeros(h.core, bool)
        grown = False
        cut_at = int(np.searchsorted(todo, h.core))
        for v in (w[i : i + ROWS] for w in (todo[:cut_at], todo[cut_at:]) for i in range(0, len(w), ROWS)):
            m = int(np.count_nonzero(h.deg[v]))
            got = np.zeros((len(v), width), np.uint8)
            if m:
                got[:m] = _union(rows, h, v[:m])
            lo, hi = np.searchsorted(sx, [v[0], v[-1] + 1])
            if hi > lo:
                at = np.minimum(np.searchsorted(v, sx[lo:hi]), len(v) - 1)
                on = v[at] == sx[lo:hi]
                np.maximum.at(got, (at[on], slot[lo:hi][on]), rank[lo:hi][on])
            if v[0] < h.core:
                more = (got.view(np.uint64) != rows[v].view(np.uint64)).any(1)
                if not more.all():
                    v, got = v[more], got[more]
                new[v] = got
                changed[v] = True
            now = count(got)
            step = now - last[v]
            grown = grown or bool(len(v)) and bool((step > 0).any())
            total[v] += depth * step
            last[v] = now
        if not (grown or changed.any()):
            depth -= 1
            break
        w = np.flatnonzero(changed)
        rows, new = new, rows
        for i in range(0, len(w), ROWS):
            new[w[i : i + ROWS]] = rows[w[i : i + ROWS]]
    far += last
    return depth


def _small(linked: DataFrame, part: DataFrame, inner: int) -> DataFrame:
    """(x, reached, distance_sum) of nodes that reach few, counted one by one."""
    near = part.where(F.col("reached") <= F.lit(SMALL + SMALL // 6)).select(F.col("x").alias("a"))
    near, (many,) = cut_counted(near)
    spark = linked.sparkSession
    schema = "x int, reached bigint, distance_sum bigint"
    if not many:
        return spark.createDataFrame([], schema)
    edges = cut(linked.select("a", "b").join(near, "a", "left_semi").select("a", "b", F.lit(-1).alias("grp")))
    tasks = max(1, min(many, spark.sparkContext.defaultParallelism))
    inputs = [edges.unionByName(near.where(F.pmod("a", F.lit(tasks)) == i).select("a", F.lit(0).alias("b"), F.lit(0).alias("grp"))).coalesce(1) for i in range(tasks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), (roots, _, _) = _inputs(batches)
        yield from _counted(a, b, roots, inner)

    out = cut(_together(inputs, edges.where("a < 0")).mapInArrow(run, schema))
    discard(edges, near)
    return out


def _counted(a: np.ndarray, b: np.ndarray, roots: np.ndarray, inner: int) -> Iterator[pa.RecordBatch]:
    """The roots that reach at most SMALL nodes, all of them sources of edges here or leading nowhere."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = max(1, len(names))
    s, t = ends[: len(a)], ends[len(a) :].astype(np.int64)
    by = np.argsort(s, kind="stable")
    s, t = s[by], t[by]
    at = np.searchsorted(s, np.arange(len(names) + 1))
    beyond = (np.diff(at) == 0) & (names < inner)  # leads on, but to nodes that are not here
    step = max(1, CELLS // SMALL)
    for lo in range(0, len(roots), step):
        own = roots[lo : lo + step]
        r = len(own)
        live, reached, total = np.ones(r, bool), np.ones(r, np.int64), np.zeros(r, np.int64)
        front = np.arange(r, dtype=np.int64) * n + np.searchsorted(names, own)
        seen, depth = [front], 0
        while len(front):
            depth += 1
            v = front % n
            k = at[v + 1] - at[v]
            which = np.repeat(np.arange(len(front)), k)
            cell = np.unique((front - v)[which] + t[np.arange(len(which)) + np.repeat(at[v] - (np.cumsum(k) - k), k)])
            for old in seen:
                cell = cell[old[np.minimum(np.searchsorted(old, cell), len(old) - 1)] != cell]
            root = cell // n
            live[root[beyond[cell % n]]] = False
            more = np.bincount(root, minlength=r)
            reached += more
            total += depth * more
            live &= reached <= SMALL
            front = cell[live[root]]
            if len(front):
                seen.append(front)
            while len(seen) > 1 and len(seen[-2]) <= 2 * len(seen[-1]):
                late = seen.pop()
                seen[-1] = np.sort(np.concatenate([seen[-1], late]))
        yield pa.RecordBatch.from_arrays([pa.array(own[live]), pa.array(reached[live]), pa.array(total[live])], ["x", "reached", "distance_sum"])
