"""Random forests grown by tasks that hold all rows, a byte per feature.

Spark's own forest gathers, for each node of a level, a histogram of every bin from every partition; deep trees have as many nodes
as rows, so most of that is zeros. Here a task has all rows and some of the trees, and its work per level follows the rows. The method
is Spark's: 32 bins, Gini impurity, a Poisson bootstrap, the root of the number of features (rounded up) looked at in each node.
Candidates for splits come from about 10,000 rows, as Spark's do; trees are grown from all. Rows are ordered by a hash and
trees have seeds of their own, so forests do not depend on partitions or on the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

MAX_CELLS = 400_000_000  # bytes that a task holds
BINS = 32
CANDIDATES = 10_000
MANY = 2_000  # rows from which a node is counted in a histogram; below, its rows are sorted by bin
BLOCK = 100_000  # rows looked at in one go


def splits(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 thresholds between the values of a feature, at its quantiles."""
    v, n = np.unique(values, return_counts=True)
    between = (v[:-1] + v[1:]) / 2
    if len(between) >= BINS:
        at = np.searchsorted(np.cumsum(n), np.arange(1, BINS) * (n.sum() / BINS))
        between = between[np.unique(np.minimum(at, len(between) - 1))]
    return between


def _binned(batch: pa.RecordBatch, features: Sequence[str], cuts: list[np.ndarray]) -> np.ndarray:
    """(row, feature): the number of thresholds below the value; null counts 0."""
    out = np.empty((len(batch), len(features)), np.uint8)
    for i, name in enumerate(features):
        out[:, i] = np.searchsorted(cuts[i], _numbers(batch.column(name)))
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)


class Tree:
    """Node i splits by feature[i]: bins up to at[i] go to child[i], the others to child[i] + 1. Leaves have no child (0); share is that of class 1."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def level(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)

    def done(self) -> tuple[np.ndarray, ...]:
        kinds = (np.uint16, np.uint8, np.int32, np.float32)
        return tuple(np.concatenate(c).astype(k) for c, k in zip(zip(*self.parts, strict=True), kinds, strict=True))


def _subsets(rng: np.random.Generator, nodes: int, features: int) -> np.ndarray:
    """For each node as many different features as the root of their number (Floyd's method)."""
    s = ceil(sqrt(features))
    out = np.empty((nodes, s), np.int64)
    for j in range(s):
        top = features - s + j
        t = rng.integers(0, top + 1, nodes)
        out[:, j] = np.where((out[:, :j] == t[:, None]).any(1), top, t)
    return out


def _score(left_w: np.ndarray, left_p: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The purer both sides, the higher; -1 where a side is empty."""
    right_w, right_p = w - left_w, p - left_p
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (left_p**2 + (left_w - left_p) ** 2) / left_w + (right_p**2 + (right_w - right_p) ** 2) / right_w
    return np.where((left_w > 0) & (right_w > 0), s, -1.0)


def _by_histogram(x: np.ndarray, row: np.ndarray, node: np.ndarray, w: np.ndarray, p: np.ndarray, subset: np.ndarray) -> tuple[np.ndarray, ...]:
    """Score, position in the subset and bin of the best split of each node; ``node`` numbers the rows' nodes from 0."""
    n, s = subset.shape
    cells = n * s * BINS
    both = np.zeros((2, cells))
    for a in range(0, len(row), BLOCK):
        at = node[a : a + BLOCK]
        r = row[a : a + BLOCK]
        key = ((at[:, None] * s + np.arange(s)) * BINS + x[r[:, None], subset[at]]).ravel()
        for i, v in enumerate((w, p)):
            both[i] += np.bincount(key, np.repeat(v[r], s), cells)
    left = both.reshape(2, n, s, BINS).cumsum(3)
    score = _score(left[0], left[1], left[0][:, :, -1:], left[1][:, :, -1:]).reshape(n, s * BINS)
    best = score.argmax(1)
    return score[np.arange(n), best], best // BINS, best % BINS


def _by_order(x: np.ndarray, row: np.ndarray, node: np.ndarray, w: np.ndarray, p: np.ndarray, subset: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same from the bins in order, for nodes of few rows."""
    n, s = subset.shape
    key = (node[:, None] * s + np.arange(s)) * BINS + x[row[:, None], subset[node]]
    key = ((key << 8) | (w[row] << 1 | (p[row] > 0))[:, None]).ravel()
    key.sort()
    kw = (key >> 1) & 127
    lw, lp = np.cumsum(kw), np.cumsum(kw * (key & 1))
    key >>= 8
    last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])  # of each bin
    key, lw, lp = key[last], lw[last], lp[last]
    group = key // BINS
    end = np.flatnonzero(np.r_[group[1:] != group[:-1], True])  # every node has rows, so there are n * s
    w0, p0 = np.r_[0, lw[end][:-1]], np.r_[0, lp[end][:-1]]
    score = _score((lw - w0[group]).astype(float), (lp - p0[group]).astype(float), (lw[end] - w0)[group].astype(float), (lp[end] - p0)[group].astype(float))
    start = np.r_[0, end[s - 1 :: s][:-1] + 1]
    most = np.maximum.reduceat(score, start)
    hit = np.flatnonzero(score == most[group // s])
    first = hit[np.searchsorted(hit, start)]
    return most, group[first] % s, key[first] % BINS


def grow(x: np.ndarray, y: np.ndarray, depth: int, seed: Sequence[int]) -> tuple[np.ndarray, ...]:
    """A tree on rows of bins ``x`` and classes ``y``."""
    rng = np.random.default_rng(seed)
    w = np.minimum(rng.poisson(1.0, len(y)), 127)
    p = w * y
    row = np.flatnonzero(w)
    tree, first, node, n = Tree(), 0, np.zeros(len(row), np.int64), 1  # rows by node, nodes of a level from 0
    if not len(row):
        tree.level(*(np.zeros(1) for _ in range(4)))
        return tree.done()
    for level in range(depth + 1):
        per = np.bincount(node, minlength=n)
        nw, np_ = np.bincount(node, w[row], n), np.bincount(node, p[row], n)
        feature, at, child = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = (np_ > 0) & (np_ < nw) if level < depth else np.zeros(n, bool)
        subset = _subsets(rng, n, x.shape[1])
        score = np.full(n, -1.0)
        ends = np.cumsum(per)
        for few in (False, True):
            mine = np.flatnonzero(live & ((per < MANY) == few))
            size = np.cumsum(per[mine])
            bounds = np.unique(np.r_[0, np.searchsorted(size, np.arange(BLOCK, size[-1], BLOCK)), len(mine)]) if few and len(mine) else np.array([0, len(mine)])
            for a, b in zip(bounds, bounds[1:], strict=False):
                some = mine[a:b]
                if len(some):
                    k = per[some]
                    pick = np.arange(k.sum()) + np.repeat(ends[some] - k - (np.cumsum(k) - k), k)
                    got = (_by_order if few else _by_histogram)(x, row[pick], np.repeat(np.arange(len(some)), k), w, p, subset[some])
                    score[some], slot, at[some] = got
                    feature[some] = subset[some, slot]
        whole = (np_**2 + (nw - np_) ** 2) / nw
        splits_ = score > whole * (1 + 1e-12)
        below = 2 * int(splits_.sum())
        child[splits_] = first + n + 2 * np.arange(below // 2)
        tree.level(feature, at, child, np_ / nw)
        if not below:
            break
        on = splits_[node]
        row, node = row[on], node[on]
        to = child[node] - first - n + (x[row, feature[node]] > at[node])
        order = np.argsort(to, kind="stable")
        row, node = row[order], to[order]
        first, n = first + n, below
    return tree.done()


def _vote(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, at, child, share = tree
    node, on = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(on):
        on = on[child[node[on]] > 0]
        here = node[on]
        node[on] = child[here] + (x[on, feature[here]] > at[here])
    return share[node]


def _homes(df: DataFrame, n: int) -> list[int]:
    """Keys that a shuffle into n partitions sends to a partition each."""
    got = df.sparkSession.range(64 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("to")).groupBy("to").agg(F.min("id").alias("id")).collect()
    return sorted(r["id"] for r in got)


def fit_predict(train: DataFrame, test: DataFrame, rows: int, features: Sequence[str], label: str, trees: int, depth: int, seed: int) -> DataFrame:
    """``test`` with Predicted and Probability; ``train`` has ``rows`` rows of class 0 or 1 in ``label``."""
    features = list(features)
    h = F.xxhash64(*features, label)
    t = train.select(*features, F.col(label).cast("int").alias("__y"), h.alias("__h"))
    unit = F.pmod(F.xxhash64("__h"), F.lit(1 << 30))
    known = t.where(unit <= int((1 << 30) * min(1.0, CANDIDATES / max(1, rows)))).select(*features).toArrow().combine_chunks()
    cuts = [splits(_numbers(known.column(i).combine_chunks() if known.num_rows else pa.array([], pa.float64()))) for i in range(len(features))]
    width = len(features)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _binned(b, features, cuts)
            at = pa.py_buffer(np.arange(0, (len(b) + 1) * width, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(b), [None, at, pa.py_buffer(x)]), b.column("__y"), b.column("__h")], ["x", "y", "h"])

    tasks = max(1, min(trees, train.sparkSession.sparkContext.defaultParallelism))
    homes = _homes(train, tasks)
    tasks = len(homes)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, hs, home = [], [], [], None
        for b in batches:
            if len(b):
                home = b.column("home")[0].as_py()
                c = b.column("x")
                lo, hi = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4)[[0, -1]]
                xs.append(np.frombuffer(c.buffers()[2], np.uint8, hi - lo, lo).reshape(-1, width).copy())
                ys.append(b.column("y").to_numpy().astype(np.int64))
                hs.append(b.column("h").to_numpy())
        if home is None:
            return
        order = np.argsort(np.concatenate(hs), kind="stable")
        x = np.concatenate(xs)
        xs.clear()
        x, y = x[order], np.concatenate(ys)[order]
        for i in range(homes.index(home), trees, tasks):
            got = grow(x, y, depth, [seed, i])
            yield pa.RecordBatch.from_arrays([pa.array([i]), *(pa.array([c.tobytes()], pa.binary()) for c in got)], ["tree", "feature", "at", "child", "share"])

    packed = t.mapInArrow(pack, "x binary, y int, h bigint").withColumn("home", F.explode(F.array(*[F.lit(k).cast("bigint") for k in homes])))
    grown = packed.repartition(len(homes), "home").mapInArrow(plant, "tree bigint, feature binary, at binary, child binary, share binary").collect()
    forest = [tuple(np.frombuffer(c, k) for c, k in zip(r[1:], (np.uint16, np.uint8, np.int32, np.float32), strict=True)) for r in sorted(grown)]
    sent = train.sparkSession.sparkContext.broadcast((forest, cuts))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, cuts = sent.value
        for b in batches:
            x = _binned(b, features, cuts)
            share = sum((_vote(tree, x).astype(np.float64) for tree in forest), np.zeros(len(b))) / len(forest)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((share > 0.5).astype(np.int32)), pa.array(share)], [*b.schema.names, "Predicted", "Probability"])

    schema = StructType([*test.schema.fields, StructField("Predicted", IntegerType()), StructField("Probability", DoubleType())])
    return test.mapInArrow(vote, schema)
