"""Most frequent values in fixed memory: external sort, run-length counts, a bounded heap per range."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.ids import id_number, sql_id_number
from edgeloom.session import cut
from edgeloom.sources.tables import load

RUN_ROWS = 1 << 20  # values sorted at once in a map task: 8 MB
HEAP = 1024  # values kept per field and range


def _sorted_runs(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[pa.RecordBatch]:
    """Sort up to RUN_ROWS values at a time and emit each run as (field, value, n)."""

    def flush(k: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        v, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v), pa.array(n.astype(np.int64))], ["field", "value", "n"])

    held: list[list[np.ndarray]] = [[] for _ in range(fields)]
    size = [0] * fields
    for b in batches:
        for k in range(fields):
            v = b.column(k).drop_null().to_numpy(zero_copy_only=False)
            if len(v):
                held[k].append(v)
                size[k] += len(v)
            if size[k] >= RUN_ROWS:
                yield flush(k, held[k])
                held[k], size[k] = [], 0
    for k in range(fields):
        if size[k]:
            yield flush(k, held[k])


def _merge_runs(batches: Iterator[pa.RecordBatch], heap_size: int) -> Iterator[pa.RecordBatch]:
    """Combine the counts of equal neighbours in sorted runs; keep the heap_size largest per field."""
    heaps: dict[int, list[tuple[int, int]]] = {}
    carry: tuple[int, int, int] | None = None

    def offer(f: int, v: np.ndarray, n: np.ndarray) -> None:
        h = heaps.setdefault(f, [])
        if len(h) >= heap_size:  # only counts that can enter
            keep = n >= h[0][0]
            v, n = v[keep], n[keep]
        if len(v) > heap_size:
            top = np.lexsort((v, -n))[:heap_size]
            v, n = v[top], n[top]
        for a, b in zip(n.tolist(), v.tolist(), strict=True):
            # ties: the smaller value stays
            if len(h) < heap_size:
                heapq.heappush(h, (a, -b))
            elif (a, -b) > h[0]:
                heapq.heapreplace(h, (a, -b))

    for b in batches:
        f, v, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if carry is not None:
            f, v, n = np.r_[carry[0], f], np.r_[carry[1], v], np.r_[carry[2], n]
        if not len(v):
            continue
        at = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (f[1:] != f[:-1])])
        total = np.add.reduceat(n, at)
        carry = int(f[at[-1]]), int(v[at[-1]]), int(total[-1])  # may go on in the next batch
        done = at[:-1]
        for k in np.unique(f[done]):
            mine = f[done] == k
            offer(int(k), v[done][mine], total[:-1][mine])
    if carry is not None:
        offer(carry[0], np.array([carry[1]]), np.array([carry[2]]))
    for k, h in heaps.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(h), k, np.int32)), pa.array([-b for _, b in h], pa.int64()), pa.array([a for a, _ in h], pa.int64())], ["field", "value", "n"]
        )


def frequent_values(df: DataFrame, fields: Mapping[str, Column], heap_size: int = HEAP) -> DataFrame:
    """(field, value, n): candidates for the most frequent BIGINT values of each field, with exact row counts.

    Each map task sorts bounded runs and counts run lengths, so a value with a third of all rows leaves it as one
    entry per run. Runs are range-partitioned by (field, value), merged in sorted order with combined counts, and each
    range keeps its ``heap_size`` largest. The ``heap_size`` most frequent values of a field are always among the
    result, ties at the end going to the smaller value; a value that holds more than 1 / heap_size of the rows is never
    lost. Nulls are no value; an empty input gives no rows. Memory per task: RUN_ROWS values and the heaps.
    """
    names = list(fields)
    schema = "field int, value bigint, n bigint"
    k = len(names)
    # written once: the sampling of range bounds reads the runs, it does not sort them again
    runs = cut(df.select(*[fields[c].alias(f"v{i}") for i, c in enumerate(names)]).mapInArrow(lambda it: _sorted_runs(it, k), schema))
    ranges = runs.repartitionByRange("field", "value").sortWithinPartitions("field", "value")
    top = ranges.mapInArrow(lambda it: _merge_runs(it, heap_size), schema)
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("field") + 1)
    return top.select(name.alias("field"), "value", "n")


def most_frequent(df: DataFrame, fields: Mapping[str, Column], k: int) -> DataFrame:
    """(field, value, n, rank): the k most frequent values of each field; ties by smaller value."""
    from pyspark.sql import Window

    cand = frequent_values(df, fields, max(k, 1))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return cand.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def frequent_share(df: DataFrame, fields: Mapping[str, Column], share: float) -> DataFrame:
    """(field, value, n): the values that hold at least ``share`` of all rows of ``df``; complete for share > 1 / HEAP."""
    size = max(HEAP, int(1 / share) + 1)
    seen = Observation()  # the rows are counted while they are sorted
    got = frequent_values(df.observe(seen, F.count(F.lit(1)).alias("rows")), fields, size)
    return got.where(F.col("n") >= F.lit(share) * F.lit(seen.get["rows"]))


SHARE = 0.005
TOP_K = 100


def _fields() -> dict[str, Column]:
    return {"target": id_number("Target"), "source": id_number("Source")}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    got = frequent_share(load(spark, d, "dynamobi"), _fields(), SHARE)
    return got.select("field", F.col("value").cast("string").alias("value"))


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    return most_frequent(load(spark, d, "dynamobi"), _fields(), TOP_K)


QUERIES = {"p4_found": p4_found, "p4_top": p4_top}

_C = f"""c as (select 'target' field, {sql_id_number('"Target"')} as value, count(*) n from dynamobi group by all
union all select 'source', {sql_id_number('"Source"')}, count(*) from dynamobi group by all)"""
ORACLE = {
    "p4_found": f"with {_C} select field, cast(value as varchar) as value from c where value is not null and n >= {SHARE} * (select count(*) from dynamobi)",
    "p4_top": f"""with {_C} select field, value, n, rank from (select *, row_number() over (partition by field order by n desc, value) rank
from c where value is not null) q where rank <= {TOP_K}""",
}
