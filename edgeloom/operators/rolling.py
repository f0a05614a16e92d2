"""Trailing totals per entity and calendar day from stored segment trees.

Time is cut into aligned shards of 64 days. Per entity and shard a segment tree holds sums and counts: node
(level, pos) covers 2**level days. A stored tree is one row: the numbers of its nodes that are not empty, in heap order
(root 1, leaves 64 to 127), and their values. A trailing window is the sum of the few stored nodes that tile it, in one
shard or several. A late correction changes a leaf and its ancestors (7 nodes) in the rows of its entity and shard; the
parts of the store that hold other rows are neither read nor written.

Scale: rows are reduced to one leaf per entity and day before entities are brought together, so an entity with a
third of all rows weighs as much as the number of days, not its rows. The tree arithmetic runs on whole batches of
entities in numpy; only leaves, trees and results cross the Arrow boundary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 6
SHARD = 1 << LEVELS
CELLS = 2_000_000  # numbers in one batch of trees: bounds a worker's memory
TASK_ROWS = 1_000_000  # result rows of a task, about
GAP = 366  # days without any row at all, after which the log counts as interrupted
PARTS = 16  # parts of the store per shard

_NO_DAY = -(1 << 30)


def first_deliveries(df: DataFrame, entity: str, ts: str, measures: Sequence[str], content: Sequence[str], arrival: str) -> DataFrame:
    """(entity, ts, measures, arrival): rows that agree in entity, day and all ``content`` columns once, with their first arrival.

    A later copy of a row is a re-delivery, not a correction. Rows with a null entity are left out; a null arrival comes last.
    """
    rows = df.where(F.col(entity).isNotNull()).select(entity, ts, *measures, arrival, _day(ts).alias("dy"), _content_hash(content).alias("h"))
    once = rows.groupBy(entity, "dy", "h").agg(*[F.first(c).alias(c) for c in [ts, *measures]], F.min(arrival).alias(arrival))
    return once.select(entity, ts, *measures, arrival)


def _day(ts: str) -> F.Column:
    return F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date"))


def _content_hash(content: Sequence[str]) -> F.Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in content])


def daily_leaves(
    df: DataFrame, entity: str, ts: str, measures: Sequence[str], content: Sequence[str] | None = None
) -> DataFrame:
    """(entity, dy, n_rows, <m>_sum, <m>_n): one leaf per entity and day; dy counts days from 1970-01-01.

    With ``content``, rows of one entity that agree in all those columns count once (re-deliveries). Rows with a null
    entity are left out; a null ``ts`` gives a leaf without a day (dy null), so that the entity still appears.
    Null measures add nothing.
    """
    rows = df.where(F.col(entity).isNotNull()).select(F.col(entity), _day(ts).alias("dy"), *measures, *([_content_hash(content).alias("h")] if content else []))
    if content:
        rows = rows.groupBy(entity, "dy", "h").agg(*[F.first(m).alias(m) for m in measures])
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for m in measures:
        aggs += [F.coalesce(F.sum(m), F.lit(0.0)).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n")]
    return rows.groupBy(entity, "dy").agg(*aggs)


def _values(measures: Sequence[str]) -> list[tuple[str, str]]:
    return [("n_rows", "bigint"), *[(f"{m}_{k}", t) for m in measures for k, t in (("sum", "double"), ("n", "bigint"))]]


def tree_rows(leaves: DataFrame, entity: str, measures: Sequence[str]) -> DataFrame:
    """(entity, shard, node, n_rows, <m>_sum, <m>_n): a stored tree per entity and shard, all but the keys arrays.

    ``node`` has the heap numbers of the nodes that are not empty, ascending; the other arrays run along with it. An
    entity's leaf without a day gives a row without a shard and without nodes. ``entity`` is BIGINT.
    """
    cols = _values(measures)
    kinds = {"bigint": (np.int64, pa.int64()), "double": (np.float64, pa.float64())}
    schema = f"{entity} bigint, shard int, node array<tinyint>, " + ", ".join(f"{c} array<{t}>" for c, t in cols)
    names = [entity, "shard", "node", *[c for c, _ in cols]]

    def trees(ids: np.ndarray, dy: np.ndarray, vals: list[np.ndarray]) -> pa.RecordBatch:
        shard = dy >> LEVELS
        at = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (shard[1:] != shard[:-1])])
        tree = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(ids)]))
        ok = dy != _NO_DAY
        owner, pos, leaf = tree[ok], dy[ok] & (SHARD - 1), [v[ok] for v in vals]
        parts = []
        for level in range(LEVELS + 1):
            if len(owner):
                number = owner * (2 * SHARD) + (SHARD >> level) + (pos >> level)
                first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                parts.append((number[first], [np.add.reduceat(v, first) for v in leaf]))
        number = np.concatenate([n for n, _ in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(number, kind="stable")
        number = number[order]
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(number // (2 * SHARD), minlength=len(at)))], pa.int32())
        arrays = [pa.array(ids[at]), pa.array(shard[at].astype(np.int32), mask=dy[at] == _NO_DAY)]
        arrays.append(pa.ListArray.from_arrays(offsets, pa.array((number % (2 * SHARD)).astype(np.int8))))
        for k, (_, t) in enumerate(cols):
            flat = np.concatenate([v[k] for _, v in parts])[order] if parts else np.zeros(0)
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(flat.astype(kinds[t][0]), kinds[t][1])))
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            dy = b.column(1).fill_null(_NO_DAY).to_numpy(zero_copy_only=False).astype(np.int64)
            vals = [b.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(cols))]
            if held is not None:
                ids, dy, vals = np.concatenate([held[0], ids]), np.concatenate([held[1], dy]), [np.concatenate(p) for p in zip(held[2], vals, strict=True)]
            if not len(ids):
                continue
            # the last tree may go on in the next batch
            last = int(np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (dy[1:] >> LEVELS != dy[:-1] >> LEVELS)])[-1])
            if last:
                yield trees(ids[:last], dy[:last], [v[:last] for v in vals])
            held = ids[last:], dy[last:], [v[last:] for v in vals]
        if held is not None and len(held[0]):
            yield trees(*held)

    src = leaves.select(F.col(entity).cast("bigint").alias(entity), F.col("dy").cast("int").alias("dy"), *[F.col(c).cast(t).alias(c) for c, t in cols])
    return src.repartition(entity).sortWithinPartitions(entity, "dy").mapInArrow(run, schema)


def tree_nodes(trees: DataFrame, entity: str) -> DataFrame:
    """The nodes of stored trees one by one: (entity, shard, level, pos, n_rows, <m>_sum, <m>_n); empty nodes are not stored."""
    cols = [c for c in trees.columns if c not in (entity, "shard")]
    flat = trees.select(entity, "shard", F.explode(F.arrays_zip(*cols)).alias("x"))
    level = F.lit(LEVELS) - F.floor(F.log2(F.col("x.node"))).cast("int")
    pos = F.col("x.node").cast("int") - F.expr(f"shiftleft(1, {LEVELS} - level)")
    return flat.withColumn("level", level).select(entity, "shard", "level", pos.alias("pos"), *[F.col(f"x.{c}") for c in cols if c != "node"])


def merge_trees(trees: DataFrame, entity: str) -> DataFrame:
    """Rows of the same entity and shard added up, node by node."""
    cols = [c for c in trees.columns if c not in (entity, "shard", "node")]
    flat = trees.select(entity, "shard", F.explode(F.arrays_zip("node", *cols)).alias("x")).select(entity, "shard", "x.*")
    per = flat.groupBy(entity, "shard", "node").agg(*[F.sum(c).alias(c) for c in cols])
    rows = per.groupBy(entity, "shard").agg(F.array_sort(F.collect_list(F.struct("node", *cols))).alias("x"))  # 127 nodes at most
    undated = trees.where("shard is null").dropDuplicates([entity])
    return rows.select(entity, "shard", *[F.col(f"x.{c}").alias(c) for c in ["node", *cols]]).unionByName(undated)


def apply_corrections(trees: DataFrame, delta: DataFrame, entity: str) -> DataFrame:
    """Trees with the trees of a correction added. Only rows of an entity and shard that the correction names are recomputed."""
    keys = delta.select(entity, "shard").distinct()
    hit = F.col(f"t.{entity}").eqNullSafe(F.col(f"k.{entity}")) & F.col("t.shard").eqNullSafe(F.col("k.shard"))
    touched = trees.alias("t").join(keys.alias("k"), hit, "left_semi")
    same = trees.alias("t").join(keys.alias("k"), hit, "left_anti")
    return same.unionByName(merge_trees(touched.unionByName(delta), entity)).select(*trees.columns)


def _parted(trees: DataFrame, entity: str, parts: int) -> DataFrame:
    out = trees.withColumn("part", F.pmod(F.xxhash64(entity), F.lit(parts)).cast("int"))
    return out.repartition("shard", "part")


def store_trees(trees: DataFrame, path: str, entity: str, parts: int = PARTS) -> None:
    """Write trees as a table in parts by shard and entity hash, the unit that a correction rewrites."""
    _parted(trees, entity, parts).write.partitionBy("shard", "part").parquet(path)


def stored_trees(spark: SparkSession, path: str, entity: str, measures: Sequence[str]) -> DataFrame:
    """The trees of a store."""
    schema = f"{entity} bigint, node array<tinyint>, " + ", ".join(f"{c} array<{t}>" for c, t in _values(measures)) + ", shard int, part int"
    return spark.read.schema(schema).parquet(path).select(entity, "shard", "node", *[c for c, _ in _values(measures)])


def correct_store(spark: SparkSession, path: str, delta: DataFrame, entity: str, measures: Sequence[str], parts: int = PARTS) -> int:
    """Add a correction to a store, reading and rewriting only the parts it falls into; gives their number.

    The parts are computed in full before any of them is replaced.
    """
    from edgeloom.session import cut, discard

    delta = cut(_parted(delta, entity, parts).select("*"))
    named = [(r[0], r[1]) for r in delta.select("shard", "part").distinct().collect()]  # PARTS a shard at most
    if not named:
        return 0
    schema = f"{entity} bigint, node array<tinyint>, " + ", ".join(f"{c} array<{t}>" for c, t in _values(measures)) + ", shard int, part int"
    here = F.lit(False)
    for shard in {s for s, _ in named}:
        mine = [p for s, p in named if s == shard]
        here = here | ((F.col("shard").isNull() if shard is None else F.col("shard") == shard) & F.col("part").isin(mine))
    touched = spark.read.schema(schema).parquet(path).where(here)
    new = cut(apply_corrections(touched.drop("part"), delta.drop("part").select(*touched.drop("part").columns), entity))
    _parted(new, entity, parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard", "part").parquet(path)
    discard(new)
    discard(delta)
    return len(named)


def canonical(first: int, last: int) -> list[tuple[int, int]]:
    """The (level, index) nodes that tile days first..last; index counts from day 0, nodes never cross a shard."""
    out = []
    while first <= last:
        level = LEVELS
        while first % (1 << level) or first + (1 << level) - 1 > last:
            level -= 1
        out.append((level, first >> level))
        first += 1 << level
    return out


def log_runs(trees: DataFrame) -> list[tuple[int, int]]:
    """First and last day of each run of the log: a run ends where GAP days pass without any row of any entity.

    One number per day of the log reaches the driver.
    """
    day = F.col("shard") * SHARD + F.col("x").cast("int") - SHARD
    leaf = trees.select("shard", F.explode(F.expr(f"filter(node, x -> x >= {SHARD})")).alias("x"))
    days = sorted(r[0] for r in leaf.select(day.alias("dy")).distinct().collect())
    cuts = [i for i in range(1, len(days)) if days[i] - days[i - 1] > GAP]
    return [(days[a], days[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(days)], strict=True) if b > a]


class _Run:
    """The window queries of one run of the log, and their answers for many entities at once."""

    def __init__(self, lo: int, hi: int, windows: Sequence[int]) -> None:
        self.lo, self.hi = lo, hi
        self.base = lo // SHARD * SHARD
        self.days = (hi // SHARD + 1) * SHARD - self.base
        self.plan = [[canonical(max(lo, d - w + 1) - self.base, d - self.base) for d in range(lo, hi + 1)] for w in windows]

    def answer(self, e: int, owner: np.ndarray, shard: np.ndarray, node: np.ndarray, vals: np.ndarray) -> list[np.ndarray]:
        """Per window an array [entity, day, measure] from the stored nodes of ``e`` entities."""
        mine = (shard >= self.base >> LEVELS) & (shard < (self.base + self.days) >> LEVELS)
        owner, node, vals = owner[mine], node[mine], vals[:, mine]
        level = LEVELS - np.frexp(node)[1].astype(np.int64) + 1
        at = ((shard[mine] * SHARD - self.base) >> level) + node - (SHARD >> level)
        tree = []
        for lv in range(LEVELS + 1):
            t = np.zeros((self.days >> lv, len(vals), e))
            here = level == lv
            for k in range(len(vals)):
                t[at[here], k, owner[here]] = vals[k][here]
            tree.append(t)
        out = []
        for per_day in self.plan:
            res = np.empty((len(per_day), len(vals), e))
            for i, nodes in enumerate(per_day):
                (lv, ix), *more = nodes
                np.copyto(res[i], tree[lv][ix])
                for lv, ix in more:
                    res[i] += tree[lv][ix]
            out.append(res.transpose(2, 0, 1))
        return out


def trailing(trees: DataFrame, entity: str, measures: Sequence[str], windows: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per entity and day of the log, days without activity included, answered from stored trees.

    Columns: entity, day, and for each window k: n_rows_k, <m>_sum_k, <m>_day_avg_k. The log runs from the first to
    the last day of all trees; where no entity has a row for more than GAP days, those empty days are left out, so one wild
    date adds one day and not thousands of years. An average divides by the days of the window that lie in
    the log, so k but for the first k - 1 days. An entity without a dated row gets zeros; an empty log gives no rows.
    ``windows`` are at most GAP days. The trees are read three times: store or ``cut`` them first. ``entity`` is BIGINT.
    """
    if max(windows) > GAP:
        raise ValueError(f"windows of more than {GAP} days are not supported")
    cols = ["n_rows", *[f"{m}_sum" for m in measures]]
    spark = trees.sparkSession
    fields = [f"{entity} bigint", "day date", "length int"]
    for k in windows:
        fields += [f"n_rows_{k} int", *[f"{m}_sum_{k} double" for m in measures]]
    schema = ", ".join(fields)
    spans = log_runs(trees)
    if not spans:
        got = spark.createDataFrame([], schema)
    else:
        names = [f.split()[0] for f in fields]
        m = len(cols)
        runs = [_Run(lo, hi, windows) for lo, hi in spans]
        step = max(1, CELLS // (m * max(2 * r.days + len(windows) * (r.hi - r.lo + 1) for r in runs)))
        tasks = max(1, trees.count() * min(SHARD, max(hi - lo + 1 for lo, hi in spans)) // TASK_ROWS)

        def chunk(ids: np.ndarray, owner: np.ndarray, shard: np.ndarray, node: np.ndarray, vals: np.ndarray) -> Iterator[pa.RecordBatch]:
            for r in runs:
                n = r.hi - r.lo + 1
                days = np.tile(np.arange(r.lo, r.hi + 1, dtype=np.int32), len(ids))
                arrays = [pa.array(np.repeat(ids, n)), pa.array(days).cast(pa.date32()), pa.array(days - np.int32(r.lo - 1))]
                for a in r.answer(len(ids), owner, shard, node, vals):
                    arrays.append(pa.array(a[:, :, 0].ravel().astype(np.int32)))
                    arrays += [pa.array(a[:, :, k].ravel()) for k in range(1, m)]
                yield pa.RecordBatch.from_arrays(arrays, names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # rows of an entity come together; the last entity of a batch may go on in the next
            held: pa.RecordBatch | None = None
            for b in batches:
                t = pa.Table.from_batches([held, b] if held is not None and held.num_rows else [b]).combine_chunks()
                if not t.num_rows:
                    continue
                b = t.to_batches()[0]
                ids = b.column(0).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                yield from done(b.slice(0, starts[-1]), starts[:-1])
                held = b.slice(starts[-1])
            if held is not None and held.num_rows:
                yield from done(held, np.array([0]))

        def done(b: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(starts), step):
                first, end = int(starts[a]), int(starts[a + step]) if a + step < len(starts) else b.num_rows
                part = b.slice(first, end - first)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                new = np.r_[True, ids[1:] != ids[:-1]]
                size = pa.compute.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.cumsum(new) - 1, size)
                shard = np.repeat(part.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), size)
                node = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                vals = np.stack([part.column(3 + k).flatten().to_numpy(zero_copy_only=False).astype(float) for k in range(m)])
                yield from chunk(ids[new], owner, shard, node, vals)

        grouped = trees.select(F.col(entity).cast("bigint").alias(entity), "shard", "node", *cols).repartition(tasks, entity).sortWithinPartitions(entity)
        got = grouped.mapInArrow(run, schema)
    out = [F.col(entity), F.col("day")]
    for k in windows:
        length = F.least(F.lit(k), F.col("length"))
        out.append(F.col(f"n_rows_{k}").cast("bigint").alias(f"n_rows_{k}"))
        for c in measures:
            out += [F.col(f"{c}_sum_{k}"), (F.col(f"{c}_sum_{k}") / length).alias(f"{c}_day_avg_{k}")]
    return got.select(*out)
