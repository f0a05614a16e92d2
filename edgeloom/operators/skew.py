"""Per-key results when a few keys hold most rows: eager aggregation through joins.

Both inputs of a join are first reduced to one compact state per join key (and finer group); the states are joined
and combined algebraically. A join of n left rows with m right rows of one key is never formed: its row count is
n * m, its sum over a left column is m times the left sum. Spark's partial aggregation runs before each shuffle, so a
key with a third of all rows sends at most one state per map task, and no task works longer because of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.session import cut_counted


def keyed_states(df: DataFrame, keys: Mapping[str, Column], sums: Mapping[str, Column], rows: str = "rows") -> DataFrame:
    """One row per key combination: the row count and the sum of each measure.

    Nulls in a measure add nothing; null keys form their own group; an empty input gives no rows. ``keys`` and
    ``sums`` name every output column, so clashing or extra columns of ``df`` cannot interfere.
    """
    out = df.select(*[c.alias(k) for k, c in keys.items()], *[c.alias(k) for k, c in sums.items()])
    return out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(rows), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in sums]
    )


def eager_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two state tables on null-safe key equality; states of both sides stay side by side.

    Null keys match each other, as they do in a GROUP BY. ``how`` is inner, left, right or full.
    """
    l, r = left.alias("l"), right.alias("r")
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    keys = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in on]
    rest = [F.col(f"l.{c}") for c in left.columns if c not in on]
    rest += [F.col(f"r.{c}") for c in right.columns if c not in on]
    return l.join(r, cond, how).select(*keys, *rest)


def joined_rollup(
    states: DataFrame,
    group: Sequence[str],
    left_rows: str,
    right_rows: str,
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    rows: str = "joined_rows",
) -> DataFrame:
    """Roll joined states up to ``group`` as if every row pair had been formed.

    counts multiply; a left sum is multiplied by the right count and a right sum by the left count.
    """
    n, m = F.col(left_rows), F.col(right_rows)
    aggs = [F.sum(n * m).alias(rows)]
    aggs += [F.sum(F.col(c) * m).alias(c) for c in left_sums]
    aggs += [F.sum(F.col(c) * n).alias(c) for c in right_sums]
    return states.groupBy(*group).agg(*aggs)


def heavy_values(states: DataFrame, left: tuple[str, str], right: tuple[str, str], share: float) -> DataFrame:
    """(field, value) of the keys that hold at least ``share`` of all rows of their side.

    ``states`` is a full ``eager_join`` on the left key; ``left`` and ``right`` are (key, row-count column). The left
    state of a key repeats once per right group, so it is taken once (max); right counts add up. Null keys count in
    the totals but are no values. One pass over the joined states; the totals are taken while the counts are written.
    """
    sides = [F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value"), F.col(n).alias("n")) for k, n in (left, right)]
    each = states.select(F.explode(F.array(*sides)).alias("x")).select("x.*").where("n is not null")
    once = F.when(F.col("field") == left[0], F.max("n")).otherwise(F.sum("n"))
    per_key = each.groupBy("field", "value").agg(once.alias("n"))
    of = lambda k: F.sum(F.when(F.col("field") == k, F.col("n")).otherwise(0))
    per_key, (_, l_total, r_total) = cut_counted(per_key, of(left[0]), of(right[0]))
    total = F.when(F.col("field") == left[0], l_total or 0).otherwise(r_total or 0)
    return per_key.where(F.col("value").isNotNull() & (F.col("n") >= F.lit(share) * total)).select("field", "value")
