"""Searches by tasks that hold a whole graph.

A graph of at most MAX_EDGES edges fits every task as a few arrays of numbers: it is broadcast once, and each task searches from its
own share of the roots in numpy. Nothing but the answer is moved or written, however many pairs are met on the way. Larger
graphs are searched level by level with joins (``graph``); both give the same rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

MAX_EDGES = 4_000_000
TASKS = 48
CELLS = 1_000_000  # (root, node) pairs that are open in a task at once
WORDS = 8  # of 64 roots each, that are searched from side by side
ROWS = 200_000  # of a batch


class Held:
    """names: the node ids in order. out_at, out_to: the successors of node i are out_to[out_at[i]:out_at[i + 1]], in order; in_at, in_from likewise."""

    def __init__(self, source: pa.Array, target: pa.Array) -> None:
        coded = pa.concat_arrays([source, target]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.names = coded.dictionary.take(pa.array(order))
        self.n = n = len(self.names)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ends = rank[coded.indices.to_numpy()]
        key = np.unique(ends[: len(source)] * max(1, n) + ends[len(source) :])
        s, t = key // max(1, n), key % max(1, n)
        self.out_at, self.out_to = _starts(s, n), t.astype(np.int32)
        by = np.argsort(t, kind="stable")
        self.in_at, self.in_from = _starts(t[by], n), s[by].astype(np.int32)

    def way(self, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        return (self.in_at, self.in_from) if reverse else (self.out_at, self.out_to)

    def most(self, reverse: bool) -> int:
        """The most edges that lead to one node."""
        at = self.out_at if reverse else self.in_at
        return int(np.diff(at).max(initial=0))


def _starts(sorted_ids: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_ids, np.arange(n + 1))


def hold(edges: DataFrame) -> Broadcast:
    """The graph (Source, Target), sent to every task; the edges pass the driver, so count them first."""
    t = edges.select("Source", "Target").toArrow()
    one = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    return edges.sparkSession.sparkContext.broadcast(Held(one(t.column(0)), one(t.column(1))))


def hold_weighted(edges: DataFrame) -> tuple[Broadcast, Broadcast]:
    """The graph of distinct (Source, Target, w), and the share of each edge in the weight of its Source, in the order of out_to."""
    t = edges.select("Source", "Target", "w").toArrow().combine_chunks()
    one = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    h = Held(one(t.column(0)), one(t.column(1)))
    s, d = (pc.index_in(one(t.column(i)), h.names).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    w = one(t.column(2)).to_numpy()[np.lexsort((d, s))]
    per = np.repeat(np.arange(h.n), np.diff(h.out_at))
    share = w / np.bincount(per, w, h.n)[per]
    sc = edges.sparkSession.sparkContext
    return sc.broadcast(h), sc.broadcast(share)


def _each_task(spark: SparkSession, tasks: int, work: Callable[[int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from work(i)

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, schema)


def _onward(at: np.ndarray, to: np.ndarray, n: int, front: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges that lead on from cells root * n + node: the cell each leads to, the number of its cell in ``front``, its position."""
    v = front % n
    k = at[v + 1] - at[v]
    which = np.repeat(np.arange(len(front)), k)
    position = np.arange(len(which)) + np.repeat(at[v] - (np.cumsum(k) - k), k)
    return (front - v)[which] + to[position], which, position


def _search(h: Held, roots: np.ndarray, max_depth: int | None, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """dist (-1: out of reach) and the number of shortest paths of each cell root * n + node."""
    (at, to), n, most = h.way(reverse), h.n, h.most(reverse)
    dist, paths = np.full(len(roots) * n, -1, np.int32), np.zeros(len(roots) * n, np.int64)
    front, depth = np.arange(len(roots)) * n + roots, 0
    dist[front], paths[front] = 0, 1
    while len(front) and (max_depth is None or depth < max_depth):
        depth += 1
        cell, which, _ = _onward(at, to, n, front)
        new = dist[cell] < 0
        cell, add = cell[new], paths[front][which[new]]
        if len(add) and float(add.max()) * most >= 2.0**63 and np.bincount(cell, add.astype(np.float64)).max() >= 2.0**63:
            raise OverflowError("more shortest paths than a BIGINT holds")
        np.add.at(paths, cell, add)
        dist[cell] = depth
        front = np.flatnonzero(dist == depth)
    return dist, paths


def _shares(h: Held, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The roots of a task, so many at once that their cells fit: ids outside the graph first, then the numbers of nodes."""
    step = max(1, CELLS // max(1, h.n))
    for b in batches:
        ids = b.column(0)
        ix = pc.index_in(ids, h.names) if h.n else pa.nulls(len(ids), pa.int32())
        known = ix.drop_null().to_numpy()
        yield ids.filter(ix.is_null()), known[:0]
        for a in range(0, len(known), step):
            yield ids[:0], known[a : a + step]


def _spread(roots: DataFrame) -> DataFrame:
    return roots.select("root").distinct().repartition(TASKS)


def path_counts(held: Broadcast, roots: DataFrame, max_depth: int | None, reverse: bool) -> DataFrame:
    """(root, node, dist, paths) of ``graph.bfs_counts``."""
    kind = roots.schema["root"].dataType.simpleString()
    columns = ["root", "node", "dist", "paths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = held.value
        for unknown, known in _shares(h, batches):
            if len(unknown):
                yield pa.RecordBatch.from_arrays([unknown, unknown, pa.array(np.zeros(len(unknown), np.int32)), pa.array(np.ones(len(unknown), np.int64))], columns)
            if len(known):
                dist, paths = _search(h, known, max_depth, reverse)
                cells = np.flatnonzero(dist >= 0)
                for a in range(0, len(cells), ROWS):
                    c = cells[a : a + ROWS]
                    yield pa.RecordBatch.from_arrays([h.names.take(pa.array(known[c // h.n])), h.names.take(pa.array(c % h.n)), pa.array(dist[c]), pa.array(paths[c])], columns)

    return _spread(roots).mapInArrow(run, f"root {kind}, node {kind}, dist int, paths bigint")


def reach_sums(held: Broadcast, spark: SparkSession, kind: str, reverse: bool) -> DataFrame:
    """(node, r, d), partial sums: how many other nodes each node reaches, and their summed distances; of those that reach it with ``reverse``.

    Bit j of a node tells that it reaches root j: 64 roots travel in a word, against the edges, level by level.
    """
    n = held.value.n
    width = 64 * WORDS
    tasks = max(1, min(TASKS, -(-n // width)))

    def work(task: int) -> Iterator[pa.RecordBatch]:
        h = held.value
        at, to = h.way(reverse)  # a node takes in what its successors have
        rows = np.flatnonzero(np.diff(at))
        r, d = np.zeros(h.n, np.int64), np.zeros(h.n, np.int64)
        chunk = max(1, 4_000_000 // WORDS)
        bounds = np.unique(np.r_[0, np.searchsorted(at[rows], np.arange(chunk, len(to), chunk)), len(rows)])
        for first in range(task * width, h.n, tasks * width):
            roots = np.arange(first, min(first + width, h.n))
            seen = np.zeros((h.n, WORDS), np.uint64)
            seen[roots, (roots - first) // 64] = np.uint64(1) << ((roots - first) % 64).astype(np.uint64)
            front, depth = seen.copy(), 0
            while True:
                depth += 1
                new = np.zeros_like(seen)
                for x, y in zip(bounds, bounds[1:], strict=False):
                    lo, hi = at[rows[x]], at[rows[y - 1] + 1]
                    new[rows[x:y]] = np.bitwise_or.reduceat(front[to[lo:hi]], at[rows[x:y]] - lo, axis=0)
                new &= ~seen
                met = np.bitwise_count(new).sum(1, dtype=np.int64)
                if not met.any():
                    break
                r += met
                d += depth * met
                seen |= new
                front = new
        yield pa.RecordBatch.from_arrays([h.names, pa.array(r), pa.array(d)], ["node", "r", "d"])

    return _each_task(spark, tasks, work, f"node {kind}, r bigint, d bigint")


def dependencies(held: Broadcast, roots: DataFrame) -> DataFrame:
    """(node, delta), partial sums of the dependencies of the roots on each other node (Brandes, 2001)."""
    kind = roots.schema["root"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = held.value
        total = np.zeros(h.n)
        source = np.repeat(np.arange(h.n), np.diff(h.out_at))
        for _, known in _shares(h, batches):
            for root in known:
                dist, paths = _search(h, np.array([root]), None, False)
                delta = np.zeros(h.n)
                on = (dist[source] > 0) & (dist[source] + 1 == dist[h.out_to])
                s, t = source[on], h.out_to[on]
                by = np.argsort(dist[s], kind="stable")
                s, t = s[by], t[by]
                at = np.searchsorted(dist[s], np.arange(dist.max(initial=0) + 2))
                for d in range(len(at) - 2, 0, -1):
                    a, b = s[at[d] : at[d + 1]], t[at[d] : at[d + 1]]
                    delta += np.bincount(a, paths[a] / paths[b] * (1.0 + delta[b]), h.n)
                delta[root] = 0.0
                total += delta
        met = np.flatnonzero(total)
        if len(met):
            yield pa.RecordBatch.from_arrays([h.names.take(pa.array(met)), pa.array(total[met])], ["node", "delta"])

    return _spread(roots).mapInArrow(run, f"node {kind}, delta double")


def flow_means(held: Broadcast, share: Broadcast, roots: DataFrame, depth: int) -> DataFrame:
    """(root, mean_score) of ``graph.propflow``; ``share``: the part of its score that a node passes on along each edge, in the order of out_to."""
    kind = roots.schema["root"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = held.value
        for unknown, known in _shares(h, batches):
            if len(unknown):
                yield pa.RecordBatch.from_arrays([unknown, pa.array(np.ones(len(unknown)))], ["root", "mean_score"])
            if len(known):
                size = len(known) * h.n
                score, level = np.zeros(size), np.full(size, -1, np.int32)
                front = np.arange(len(known)) * h.n + known
                score[front], level[front] = 1.0, 0
                for d in range(depth):
                    cell, which, edge = _onward(h.out_at, h.out_to, h.n, front)
                    score += np.bincount(cell, score[front][which] * share.value[edge], size)
                    level[cell[level[cell] < 0]] = d + 1
                    front = np.flatnonzero(level == d + 1)
                met = (level >= 0).reshape(len(known), h.n).sum(1)
                yield pa.RecordBatch.from_arrays([h.names.take(pa.array(known)), pa.array(score.reshape(len(known), h.n).sum(1) / met)], ["root", "mean_score"])

    return _spread(roots).mapInArrow(run, f"root {kind}, mean_score double")


def _distances_to(h: Held, target: int) -> np.ndarray:
    dist = np.full(h.n, -1, np.int32)
    front, depth = np.array([target]), 0
    dist[target] = 0
    while len(front):
        depth += 1
        cell, _, _ = _onward(h.in_at, h.in_from, h.n, front)
        dist[cell[dist[cell] < 0]] = depth
        front = np.flatnonzero(dist == depth)
    return dist


def _flow(onward: Callable[[int], list[int]], s: int, t: int, n: int, most: int) -> int:
    """Edge-disjoint paths from s to t, at most ``most``: augmenting paths, depth first towards t; ``onward`` are successors, the nearest to t first."""
    used: set[int] = set()
    back: dict[int, set[int]] = {}
    flow = 0
    while flow < most:
        seen, path, ways = {s}, [s], [iter(onward(s))]
        reverse = [False]
        while path and path[-1] != t:
            u = path[-1]
            for v in ways[-1]:
                if v not in seen and (reverse[-1] or u * n + v not in used):
                    seen.add(v)
                    path.append(v)
                    ways.append(iter(onward(v) if v != t else ()))
                    reverse.append(False)
                    break
            else:
                if not reverse[-1] and u in back:
                    # then the other way along paths found before
                    ways[-1], reverse[-1] = iter(tuple(back[u])), True
                else:
                    path.pop(), ways.pop(), reverse.pop()
        if not path:
            break
        for i, (u, v) in enumerate(zip(path, path[1:], strict=False)):
            if reverse[i]:
                used.discard(v * n + u)
                back[u].discard(v)
            else:
                used.add(u * n + v)
                back.setdefault(v, set()).add(u)
        flow += 1
    return flow


def flows(held: Broadcast, pairs: DataFrame, most: int) -> DataFrame:
    """(Source, Target, f): most edge-disjoint paths of each pair, counted up to ``most``; a task looks at one Target after the other."""
    kind = pairs.schema["Source"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = held.value
        t, near, lists = -1, None, {}

        def onward(u: int) -> list[int]:
            got = lists.get(u)
            if got is None:
                v = h.out_to[h.out_at[u] : h.out_at[u + 1]]
                v = v[(near[v] >= 0) & (v != u)]
                got = lists[u] = v[np.argsort(near[v], kind="stable")].tolist()
            return got

        for b in batches:
            found = []
            ends = [pc.index_in(b.column(i), h.names).to_pylist() if h.n else [None] * len(b) for i in (0, 1)]
            for x, y in zip(*ends, strict=True):
                if x is None or y is None:
                    found.append(0)
                    continue
                if y != t:
                    t, near, lists = y, _distances_to(h, y), {}
                into = h.in_from[h.in_at[t] : h.in_at[t + 1]]
                bound = min(len(onward(x)), int((into != t).sum()), most) if near[x] >= 0 else 0
                found.append(_flow(onward, x, t, h.n, bound))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["Source", "Target", "f"])

    return pairs.repartition(TASKS).sortWithinPartitions("Target").mapInArrow(run, f"Source {kind}, Target {kind}, f bigint")


def walks(held: Broadcast, spark: SparkSession, length: int, num_walks: int, step: Callable[[Held], Callable]) -> DataFrame:
    """(walk_id, walk): ``step(held)`` gives a function of (walk_id, number of the step, node, node before) to the next node, None at an end."""
    n = held.value.n
    tasks = max(1, min(4 * TASKS, n))

    def work(task: int) -> Iterator[pa.RecordBatch]:
        h = held.value
        move = step(h)
        names = h.names.cast(pa.string())
        ids: list[str] = []
        nodes: list[int] = []
        ends = [0]
        for v in range(task, h.n, tasks):
            name = names[v].as_py()
            for no in range(num_walks):
                walk_id = f"{name}#{no}"
                at, prev = v, None
                nodes.append(at)
                for k in range(1, length):
                    to = move(walk_id, k, at, prev)
                    if to is None:
                        break
                    at, prev = to, at
                    nodes.append(at)
                ids.append(walk_id)
                ends.append(len(nodes))
            if len(nodes) > ROWS or v + tasks >= h.n:
                walk = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(nodes, pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(ids), walk], ["walk_id", "walk"])
                ids, nodes, ends = [], [], [0]

    return _each_task(spark, tasks, work, "walk_id string, walk array<string>")


def uniform_step(seed: int) -> Callable[[Held], Callable]:
    def of(h: Held) -> Callable:
        at, to = memoryview(h.out_at), memoryview(h.out_to)

        def move(walk_id: str, k: int, u: int, prev: int | None) -> int | None:
            lo, hi = at[u], at[u + 1]
            return to[lo + _hash_int(f"{seed}|{walk_id}|{k}") % (hi - lo)] if hi > lo else None

        return move

    return of


def second_order_step(p: float, q: float, seed: int) -> Callable[[Held], Callable]:
    """Proposals in order, the first accepted one taken (``operators.walks.node2vec_walks``)."""
    top = max(1.0, 1.0 / q)
    beyond = max(0.0, 1.0 / p - top)
    unit = float(1 << 32)

    def of(h: Held) -> Callable:
        at, to = memoryview(h.out_at), memoryview(h.out_to)

        def linked(u: int, v: int) -> bool:
            i = bisect_left(to, v, at[u], at[u + 1])
            return i < at[u + 1] and to[i] == v

        def move(walk_id: str, k: int, u: int, prev: int | None) -> int | None:
            lo, many = at[u], at[u + 1] - at[u]
            if not many:
                return None
            extra = beyond if beyond and prev is not None and linked(u, prev) else 0.0
            for j in count():
                h = lambda tag, j=j: _hash_int(f"{seed}|{walk_id}|{k}|{j}|{tag}")
                if extra > 0 and h("area") / unit < extra / (many * top + extra):
                    return prev
                v = to[lo + h("at") % many]
                weight = top if prev is None else min(1.0 / p, top) if v == prev else 1.0 if linked(prev, v) else 1.0 / q
                if h("accept") / unit < weight / top:
                    return v

        return move

    return of


def _hash_int(text: str) -> int:
    """``functions.hashing.hash_int`` of the joined text."""
    return int.from_bytes(md5(text.encode(), usedforsecurity=False).digest()[:4], "big")
