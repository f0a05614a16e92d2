"""Filling fixed-capacity containers: bounded-space online packing, best fit, leftovers merged at the end."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.tokens import TOKENIZER, with_tokens
from edgeloom.session import cut
from edgeloom.sources.tables import load

WINDOWS = 64  # open containers per task and capacity
FAN_IN = 32  # tasks whose leftovers meet in one task of the next round


class Packer:
    """At most ``windows`` open containers. ``place`` gives the container an item goes to and the one emitted, if any.

    An item goes to the open container with the least room that still holds it (ties: the oldest); if none holds it,
    it opens a new one, and when all windows are taken the fullest is emitted first. A full container is emitted at once.
    """

    def __init__(self, capacity: int, windows: int = WINDOWS) -> None:
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, int]] = []  # (room, container), sorted
        self.made = 0

    def place(self, size: int) -> tuple[int, list[int]]:
        closed: list[int] = []
        at = bisect.bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, c = self.open.pop(at)
        else:
            if len(self.open) >= self.windows:
                closed.append(self.open.pop(0)[1])
            room, c = self.capacity, self.made
            self.made += 1
        if room == size:
            closed.append(c)
        else:
            bisect.insort(self.open, (room - size, c))
        return c, closed


def cut_sizes(size: int, capacity: int) -> list[int]:
    """Pieces of an item: only one longer than the capacity is cut, into full containers and a rest."""
    full, rest = divmod(size, capacity)
    return [size] if size <= capacity else [capacity] * full + [rest] * (rest > 0)


_PIECE = "pack_id int, capacity bigint, container string, item bigint, piece int, tokens bigint, closed boolean, grp int"
_NAMES = [f.split()[0] for f in _PIECE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32()]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _NAMES)


def _pack_items(packs: Sequence[tuple[int, int]], windows: int, fan_in: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packers = {p: Packer(c, windows) for p, c in packs}
        held: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        out: list[tuple] = []

        def emit(p: int, cap: int, c: int, closed: bool) -> None:
            out.extend((p, cap, f"0-{task}-{c}", i, k, n, closed, task // fan_in) for i, k, n in held.pop((p, c)))

        for b in batches:
            for item, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p, cap in packs:
                    if not size:
                        out.append((p, cap, None, item, 0, 0, True, 0))
                        continue
                    for k, n in enumerate(cut_sizes(size, cap)):
                        c, closed = packers[p].place(n)
                        held.setdefault((p, c), []).append((item, k, n))
                        for x in closed:
                            emit(p, cap, x, True)
            if len(out) >= 20_000:
                yield _batch(out)
                out = []
        for p, cap in packs:
            for _, c in packers[p].open:
                emit(p, cap, c, False)
        yield _batch(out)

    return run


def _merge_leftovers(level: int, windows: int, fan_in: int, last: bool) -> Callable:
    """Pack whole leftover containers into new ones; rows come sorted by group, pack, fill (fullest first), container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        packer, scope, held = None, None, {}
        unit: list[tuple] = []

        def emit(c: int, closed: bool) -> None:
            g, p, cap = scope
            out.extend((p, cap, f"{level}-{g}-{c}", i, k, n, closed or last, g // fan_in) for i, k, n in held.pop(c))

        def put() -> None:
            if not unit:
                return
            c, closed = packer.place(sum(n for *_, n in unit))
            held.setdefault(c, []).extend(unit)
            unit.clear()
            for x in closed:
                emit(x, True)

        def finish() -> None:
            put()
            if packer is not None:
                for _, c in packer.open:
                    emit(c, False)

        key = None
        for b in batches:
            for g, p, cap, container, i, k, n in zip(*[b.column(c).to_pylist() for c in ("grp", "pack_id", "capacity", "container", "item", "piece", "tokens")], strict=True):
                if scope != (g, p, cap):
                    finish()
                    scope, packer, held, key = (g, p, cap), Packer(cap, windows), {}, container
                elif key != container:
                    put()
                    key = container
                unit.append((i, k, n))
            if len(out) >= 20_000:
                yield _batch(out)
                out = []
        finish()
        yield _batch(out)

    return run


def pack(sizes: DataFrame, item: str, size: str, packs: Sequence[tuple[int, int]], windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """(pack_id, capacity, container, item, piece, tokens): every item's place for each capacity.

    One pass per partition keeps ``windows`` open containers of each capacity. What is still open at the end of a
    partition is merged, whole containers at a time, with the leftovers of ``fan_in`` partitions, round after round,
    so that no task ever sees more than fan_in * windows leftovers per capacity. An item longer than the capacity is cut
    into full pieces and a rest; no other is. An item of size 0 or null has one row with no container; repeated ids are
    separate items; an empty input or no capacity gives no rows. A capacity below 1 raises ValueError.
    ``packs`` is (pack_id, capacity), a few rows.
    """
    spark = sizes.sparkSession
    if any(c is None or c < 1 for _, c in packs):
        raise ValueError("a capacity must be at least 1")
    if not packs:
        return spark.createDataFrame([], _PIECE).drop("closed", "grp")
    src = sizes.select(F.col(item).cast("bigint"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)))
    # the containers of a task must not change when it is run again: packed once, kept in the shared folder
    done = cut(src.mapInArrow(_pack_items(packs, windows, fan_in), _PIECE))
    result = done.where("closed")
    left, level = done.where("not closed"), 1
    groups = 1 + (left.agg(F.max("grp")).first()[0] or 0)
    while True:
        fill = F.sum("tokens").over(_by_container())
        ordered = (
            left.withColumn("fill", fill)
            .repartition(max(1, groups), "grp")
            .sortWithinPartitions("grp", "pack_id", F.desc("fill"), "container", "item", "piece")
            .select(*_NAMES)
        )
        merged = cut(ordered.mapInArrow(_merge_leftovers(level, windows, fan_in, groups == 1), _PIECE))
        result = result.unionByName(merged.where("closed"))
        if groups == 1:
            break
        left, groups, level = merged.where("not closed"), (groups + fan_in - 1) // fan_in, level + 1
    return result.drop("closed", "grp")


def _by_container():
    from pyspark.sql import Window

    return Window.partitionBy("pack_id", "container")


def pack_summary(placed: DataFrame) -> DataFrame:
    """Per capacity: containers, items, cut items, tokens and the share of the space that is used."""
    per = placed.where("container is not null").groupBy("pack_id", "capacity", "container").agg(F.sum("tokens").alias("t"))
    space = per.groupBy("pack_id", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.min("t").alias("emptiest")
    )
    return space.withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))


def _packs(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    """The capacities: a table of a few rows."""
    rows = load(spark, d, "pack_sizes").where("pack_id is not null and capacity_tokens is not null").distinct().collect()
    return sorted((int(r.pack_id), int(r.capacity_tokens)) for r in rows)


def p6_packed(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    sizes = with_tokens(load(spark, d, "documents"), "text", ["doc_id"], tokenizer)
    return pack(sizes, "doc_id", "n_tokens", _packs(spark, d)).withColumnRenamed("item", "doc_id")


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return pack_summary(p6_packed(spark, d))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity, what must hold: every document placed, no container too full, only longer texts cut, and into as few pieces as possible."""
    sizes = cut(with_tokens(load(spark, d, "documents"), "text", ["doc_id"], TOKENIZER))
    packs = _packs(spark, d)
    placed = cut(pack(sizes, "doc_id", "n_tokens", packs))
    full = placed.where("container is not null").groupBy("pack_id", "capacity", "container").agg(F.sum("tokens").alias("t"))
    over = full.groupBy("pack_id").agg(F.count(F.when(F.col("t") > F.col("capacity"), 1)).alias("overfull"))
    per = placed.groupBy("pack_id", "capacity", "item").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("t"), F.count_distinct("piece").alias("kinds"))
    every = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in packs])).alias("k")
    j = sizes.select("doc_id", "n_tokens", every).select("doc_id", "n_tokens", "k.*").join(per.withColumnRenamed("item", "doc_id"), ["pack_id", "capacity", "doc_id"], "left")
    few = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity")))
    out = j.groupBy("pack_id", "capacity").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("pieces").isNull() | (F.col("t") != F.col("n_tokens")), 1)).alias("lost"),
        F.count(F.when((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity")), 1)).alias("cut_needlessly"),
        F.count(F.when((F.col("pieces") != few) | (F.col("kinds") != F.col("pieces")), 1)).alias("cut_badly"),
    )
    return out.join(over, "pack_id", "left").fillna(0, ["overfull"])


QUERIES = {"p6_packed": p6_packed, "p6_summary": p6_summary, "p6_check": p6_check}
ORACLE: dict[str, str] = {
    "p6_check": """select distinct pack_id, cast(capacity_tokens as bigint) capacity, (select count(*) from documents) documents, 0::bigint lost, 0::bigint cut_needlessly,
    0::bigint cut_badly, 0::bigint overfull from pack_sizes where pack_id is not null and capacity_tokens is not null""",
}
