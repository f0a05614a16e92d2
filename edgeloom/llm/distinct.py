"""Distinct counts from log-log registers: mergeable, with a stated standard error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.ids import id_number, sql_id_number
from edgeloom.session import cut
from edgeloom.sources.tables import load

LOG_REGISTERS = 12


def standard_error(log_registers: int = LOG_REGISTERS) -> float:
    """Relative standard error of the estimate with 2**log_registers registers."""
    return 1.04 / sqrt(1 << log_registers)


def sketches(df: DataFrame, dims: Mapping[str, Column], items: Mapping[str, Column], log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(dims..., n_rows, <item>): one mergeable sketch per finest group and item.

    A sketch holds registers of the largest leading-zero rank of its hashes. Partial sketches are made before the
    shuffle, so a group with a third of all rows sends one sketch of fixed size per task. Null items are not counted;
    null dims are their own group; an empty input gives no rows.
    """
    flat = df.select(*[c.alias(k) for k, c in dims.items()], *[c.alias(k) for k, c in items.items()])
    return flat.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.hll_sketch_agg(k, F.lit(log_registers)).alias(k) for k in items]
    )


def _sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    return [s for k in range(len(dims), -1, -1) for s in combinations(dims, k)]


def _groupings(dims: Sequence[str]) -> Column:
    """All combinations of dims a row counts in, named by ``grouping``."""
    return F.array(*[F.struct(F.lit(",".join(s)).alias("grouping"), *[(F.col(c) if c in s else F.lit(None)).alias(c) for c in dims]) for s in _sets(dims)])


def merge_all_groups(parts: DataFrame, dims: Sequence[str], items: Sequence[str], log_registers: int = LOG_REGISTERS) -> DataFrame:
    """Estimates for every combination of dims, each merged by register maximum from the finest sketches.

    ``grouping`` names the dims a row is about, '' for all rows together. Sketches of other days or other clusters
    may be added to ``parts`` by UNION ALL beforehand. The input is as small as the groups, whatever the rows.
    """
    wide = parts.withColumn("g", F.explode(_groupings(dims))).select("g.grouping", *[f"g.{c}" for c in dims], "n_rows", *items)
    out = wide.groupBy("grouping", *dims).agg(
        F.sum("n_rows").alias("n_rows"), *[F.hll_sketch_estimate(F.hll_union_agg(k)).alias(f"distinct_{k}") for k in items]
    )
    return out.withColumn("standard_error", F.lit(standard_error(log_registers)))


def _dims() -> dict[str, Column]:
    return {"day": F.col("Date").cast("date"), "feed": F.col("feed"), "split": F.col("split")}


def _items() -> dict[str, Column]:
    s, t = id_number("Source"), id_number("Target")
    pair = F.when(s.isNotNull() & t.isNotNull(), F.xxhash64(s, t))
    return {"source": s, "target": t, "pair": pair}


def p5_distinct(spark: SparkSession, d: str) -> DataFrame:
    parts = sketches(load(spark, d, "dynamobi"), _dims(), _items())
    return merge_all_groups(parts, list(_dims()), list(_items()))


def p5_partials(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable partial results themselves: a sketch per day, feed, split and item, to be stored and joined later."""
    return sketches(load(spark, d, "dynamobi"), _dims(), _items()).withColumn("standard_error", F.lit(standard_error()))


def registers(df: DataFrame, dims: Mapping[str, Column], items: Mapping[str, Column], log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(dims..., item, register, rank): the plain form of sketches, from md5, so that any engine can rebuild and merge them.

    register is the first ``log_registers`` bits of md5(value), rank the position of the first 1 among the next 32.
    Merge by max(rank) per register. Null values are not counted.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("item"), c.cast("string").alias("v")) for k, c in items.items()])).alias("x")
    flat = df.select(*[c.alias(k) for k, c in dims.items()], each).where("x.v is not null").select(*dims, "x.item", F.md5("x.v").alias("h"))
    head = F.conv(F.substring("h", 1, 4), 16, 10).cast("int")
    tail = F.conv(F.substring("h", 5, 8), 16, 10).cast("bigint")
    rank = F.lit(33) - F.when(tail > 0, F.length(F.bin(tail))).otherwise(0)
    flat = flat.select(*dims, "item", F.shiftright(head, 16 - log_registers).alias("register"), rank.alias("rank"))
    return flat.groupBy(*dims, "item", "register").agg(F.max("rank").alias("rank"))


def merge_registers(regs: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(grouping, dims..., item, register, rank) for every combination of dims, merged by maximum from the finest ones."""
    wide = regs.withColumn("g", F.explode(_groupings(dims))).select("g.grouping", *[f"g.{c}" for c in dims], "item", "register", "rank")
    return wide.groupBy("grouping", *dims, "item", "register").agg(F.max("rank").alias("rank"))


def register_estimates(regs: DataFrame, dims: Sequence[str], log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(dims..., estimate): the raw harmonic mean, with linear counting while it is below 2.5 registers' worth."""
    m = float(1 << log_registers)
    alpha = 0.7213 / (1 + 1.079 / m)
    agg = regs.groupBy(*dims).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("z"), F.count(F.lit(1)).alias("used"))
    raw = F.lit(alpha * m * m) / (F.col("z") + (F.lit(m) - F.col("used")))
    linear = F.lit(m) * F.log(F.lit(m) / (F.lit(m) - F.col("used")))
    est = F.when((raw <= 2.5 * m) & (F.col("used") < m), linear).otherwise(raw)
    return agg.select(*dims, F.round(est, 3).alias("estimate"))


def p5_registers_cube(spark: SparkSession, d: str) -> DataFrame:
    """Distinct Sources, Targets and pairs per day, feed, split and all their combinations, from explicit md5 registers."""
    s, t = id_number("Source").cast("string"), id_number("Target").cast("string")
    pair = F.when(s.isNotNull() & t.isNotNull(), F.concat(s, F.lit("|"), t))
    regs = registers(load(spark, d, "dynamobi"), _dims(), {"source": s, "target": t, "pair": pair})
    dims = ["grouping", *_dims(), "item"]
    return register_estimates(merge_registers(regs, list(_dims())), dims).withColumn("standard_error", F.round(F.lit(standard_error()), 6))


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The estimates of ``p5_distinct`` beside exact counts: how many cells there are, and how many lie beyond 5 standard errors (and 2)."""
    dyn = cut(load(spark, d, "dynamobi").select(*[c.alias(k) for k, c in _dims().items()], *[c.alias(f"x_{k}") for k, c in _items().items()]))
    est = merge_all_groups(sketches(dyn, {k: F.col(k) for k in _dims()}, {k: F.col(f"x_{k}") for k in _items()}), list(_dims()), list(_items()))
    kinds = [(k, t) for k, t in dyn.dtypes if k in _dims()]
    # exact: the cells of each value, no more than there are finest groups, then its cells of each grouping; only counts move on
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("item"), F.col(f"x_{k}").alias("v")) for k in _items()])).alias("x")
    per = dyn.select(each, F.struct(*_dims()).alias("cell")).where("x.v is not null").groupBy("x.item", "x.v").agg(F.collect_set("cell").alias("cells"))

    def seen_in(keep: tuple[str, ...]) -> Column:
        return F.transform("cells", lambda c: F.struct(F.lit(",".join(keep)).alias("grouping"), *[(c[k] if k in keep else F.lit(None).cast(t)).alias(k) for k, t in kinds]))

    cells = [seen_in(keep) for keep in _sets(list(_dims()))]
    wide = per.select("item", F.explode(F.array_distinct(F.concat(*cells))).alias("g")).select("g.*", "item")
    exact = wide.groupBy("grouping", *_dims(), "item").agg(F.count(F.lit(1)).alias("exact"))
    long = est.select("grouping", *_dims(), F.explode(F.array(*[F.struct(F.lit(k).alias("item"), F.col(f"distinct_{k}").alias("estimate")) for k in _items()])).alias("x"))
    long = long.select("grouping", *_dims(), "x.*")
    a, b = long.alias("a"), exact.alias("b")
    on = F.lit(True)
    for k in ["grouping", *_dims(), "item"]:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    off = F.abs(F.col("estimate") - F.coalesce("exact", F.lit(0)))
    wrong = off > F.greatest(F.lit(2.0), F.lit(5 * standard_error()) * F.coalesce("exact", F.lit(0)))
    return a.join(b, on, "left").groupBy("a.grouping", "a.item").agg(
        F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_sum"), F.count(F.when(wrong, 1)).alias("beyond")
    )


QUERIES = {"p5_distinct": p5_distinct, "p5_partials": p5_partials, "p5_registers_cube": p5_registers_cube, "p5_agreement": p5_agreement}

_M = 1 << LOG_REGISTERS
_SETS = _sets(["day", "feed", "split"])
_V = f"""v as (select cast("Date" as date) as "day", feed, split, cast({sql_id_number('"Source"')} as varchar) s, cast({sql_id_number('"Target"')} as varchar) t from dynamobi),
m as (select * from (values {', '.join(f"('{','.join(s)}', {', '.join(str(k in s).lower() for k in ('day', 'feed', 'split'))})" for s in _SETS)}) q(grouping, by_day, by_feed, by_split)),
w as (select grouping, case when by_day then "day" end "day", case when by_feed then feed end feed, case when by_split then split end split, s, t from v, m),
i as (select grouping, "day", feed, split, 'source' item, s x from w union all select grouping, "day", feed, split, 'target', t from w union all select grouping, "day", feed, split, 'pair', s || '|' || t from w)"""
ORACLE = {
    "p5_registers_cube": f"""with {_V},
b as (select distinct grouping, "day", feed, split, item, cast('0x' || substr(md5(x), 1, 4) as int) >> {16 - LOG_REGISTERS} register, cast('0x' || substr(md5(x), 5, 8) as bigint) tail from i where x is not null),
r as (select grouping, "day", feed, split, item, register, max(33 - case when tail > 0 then length(bin(tail)) else 0 end) rank from b group by all),
g as (select grouping, "day", feed, split, item, sum(pow(2.0, -rank)) z, count(*) used from r group by all),
e as (select *, {0.7213 / (1 + 1.079 / _M) * _M * _M}::double / (z + ({_M} - used)) raw from g)
select grouping, "day", feed, split, item, round(case when raw <= {2.5 * _M} and used < {_M} then {float(_M)}::double * ln({float(_M)}::double / ({_M} - used)) else raw end, 3) estimate,
    round({standard_error()}::double, 6) standard_error from e""",
    "p5_agreement": f"""with {_V},
c as (select grouping, "day", feed, split, item, count(distinct x) n from i group by all)
select grouping, item, count(*) cells, cast(sum(n) as bigint) exact_sum, 0::bigint beyond from c group by all""",
}
