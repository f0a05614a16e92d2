"""Total orders, prefixes and splits that no single task has to see whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.hashing import key_hash
from edgeloom.session import cut, cut_counted


BUCKETS = 4096  # counts of a pass that narrows a boundary
SMALL = 100_000  # rows at a boundary that are put in order by one heap per task


def global_rank(df: DataFrame, by: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """Add a gapless 1-based rank in the order of ``by`` (BIGINT).

    Range-partitioned sort, then each partition's start from the row counts of those before it: a few numbers per
    partition, instead of a window without partitions that pulls all rows into one task. The order should be total;
    rows that tie get ranks in an arbitrary but stable order. Nulls sort first. Empty input gives no rows. The rows are
    read twice, by the sampling of range bounds and by the sort: ``cut`` them first where they are costly.
    """
    spark = df.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    pos = "__pos"
    ordered = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(pos, F.monotonically_increasing_id()))
    part = F.shiftright(pos, 33)
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}  # one number per partition
    start, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, start))
        start += sizes[p]
    offsets = spark.createDataFrame(rows, "__p bigint, __start bigint")
    mask = F.col(pos).bitwiseAND((1 << 33) - 1)
    out = ordered.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return out.withColumn(name, F.col("__start") + mask + 1).drop("__p", "__start", pos)


def among_first(df: DataFrame, value: Column, by: Sequence[str | Column], n: int) -> Column:
    """A condition on ``df`` that holds for its first ``n`` rows in the order of ``value`` (BIGINT, never null), then ``by``.

    No row is sorted or moved: rows are counted per bucket of values, then per bucket of the boundary bucket, until few
    are left there (or one value), and only those are put in order to find the boundary row. At most 4096 counts a pass
    reach the driver. Rows that tie with the n-th in everything are all in. ``df`` is read a few times, two columns or so
    of it: ``cut`` it first where it is costly.
    """
    if n <= 0:
        return F.lit(False)
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    v = df.select(value.alias("v"))
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return F.lit(True)
    before = 0
    while True:
        width = (hi - lo) // BUCKETS + 1
        per = v.where(F.col("v").between(lo, hi)).groupBy(F.expr(f"(v - {lo}L) div {width}L").alias("b")).count().collect()
        for b, rows in sorted((r[0], r[1]) for r in per):  # noqa: B007
            if before + rows >= n:
                break
            before += rows
        else:
            return F.lit(True)
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
        if before + rows == n:
            return value <= F.lit(hi)
        if rows <= SMALL or lo == hi:
            break
    named = [value.alias("__v"), *[k.alias(f"__k{i}") for i, k in enumerate(keys)]]
    edge = df.where(value.between(lo, hi)).select(*named)
    names = edge.columns
    if rows <= SMALL:
        last = edge.orderBy(*names).limit(n - before).agg(F.max(F.struct(*names)).alias("m")).first()["m"]
    else:
        last = global_rank(edge, names, "__rn").where(F.col("__rn") == n - before).select(F.struct(*names).alias("m")).first()["m"]
    bound = F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(last, edge.schema.fields, strict=True)])
    return F.struct(*named) <= bound


def prefix(df: DataFrame, by: Sequence[str | Column], n: int, value: Column | None = None) -> DataFrame:
    """The first n rows in the order of ``by``, by ``value`` before it where one is given (see ``among_first``)."""
    df = cut(df)
    if value is None:
        return global_rank(df, by, "__rn").where(F.col("__rn") <= n).drop("__rn")
    return df.where(among_first(df, value, by, n))


def fraction_split(df: DataFrame, by: Sequence[str | Column], share: float, cap: int | None = None, name: str = "part", value: Column | None = None) -> DataFrame:
    """Label the first floor(n * share) rows 'train', the rest 'test'; ``cap`` keeps only that many test rows.

    ``value`` as in ``prefix``; without it all rows are ranked.
    """
    df, (n,) = cut_counted(df)
    at = int(n * share)
    if value is None:
        df = global_rank(df, by, "__rn")
        first = lambda k: F.col("__rn") <= k
    else:
        first = lambda k: F.lit(True) if k >= n else among_first(df, value, by, k)
    kept = df if cap is None else df.where(first(at + cap))
    return kept.withColumn(name, F.when(first(at), "train").otherwise("test")).drop("__rn")


def by_hash(seed: int, *keys: str) -> dict:
    """Arguments ``by`` and ``value`` of a seeded random order."""
    return {"by": shuffled(seed, *keys), "value": F.conv(F.substring(key_hash(seed, *keys), 1, 13), 16, 10).cast("bigint")}


def by_time(ts: str, *keys: str) -> dict:
    """Arguments ``by`` and ``value`` of an order by moment, nulls last, then by ``keys``; counted by seconds."""
    c = F.col(ts)
    seconds = F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return {"by": [c, *[F.col(k) for k in keys]], "value": F.coalesce(seconds, F.lit(1 << 40))}


def running_total(ranked: DataFrame, value: str) -> DataFrame:
    """Running total in rank order by blocks of 100,000 ranks: totals inside a block plus those of the blocks before."""
    blocked = ranked.withColumn("__blk", F.floor(F.col("rn") / 100_000))
    inner = blocked.withColumn("__in", F.sum(value).over(Window.partitionBy("__blk").orderBy("rn")))
    per = blocked.groupBy("__blk").agg(F.sum(value).alias("__s")).collect()  # one number per 100,000 ranks
    run, rows = 0, []
    for blk, s in sorted((r[0], r[1] or 0) for r in per):
        rows.append((blk, run))
        run += s
    base = ranked.sparkSession.createDataFrame(rows, "__blk bigint, __base bigint")
    return inner.join(F.broadcast(base), "__blk").withColumn("total", F.col("__base") + F.col("__in")).drop("__blk", "__in", "__base")


def shuffled(seed: int, *keys: str) -> list[Column]:
    """A seeded random order: md5 of the keys, then the keys themselves."""
    return [key_hash(seed, *keys), *[F.col(k) for k in keys]]
