"""Queries of the two general problems (skewed keys, trailing totals) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.ids import amount, id_number, sql_amount, sql_id_number
from edgeloom.operators import rolling, skew
from edgeloom.session import cut, scratch
from edgeloom.sources.tables import load

HEAVY_SHARE = 0.015


def _target_states(spark: SparkSession, d: str) -> DataFrame:
    return skew.keyed_states(
        load(spark, d, "dynamobi"),
        {"target": id_number("Target")},
        {"calls": amount("Calls"), "seconds": amount("duration")},
    )


def _hit() -> F.Column:
    return (F.col("Predicted") == F.col("Class")).cast("bigint")


def _debug_states(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    every = {"target": id_number("Target"), "hub": F.col("Hub")}
    return skew.keyed_states(
        load(spark, d, "debug"),
        {k: every[k] for k in keys},
        {"hits": _hit(), "judged": _hit().isNotNull().cast("bigint")},
        rows="hub_rows",
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    states = skew.eager_join(_target_states(spark, d).drop("calls", "seconds"), _debug_states(spark, d, "target", "hub").drop("hits", "judged"), ["target"], "full")
    return skew.heavy_values(states, ("target", "rows"), ("hub", "hub_rows"), HEAVY_SHARE)


def p2_target_load(spark: SparkSession, d: str) -> DataFrame:
    """Rows, calls and seconds of every Target; the null row holds ids without a number."""
    s = _target_states(spark, d)
    return s.select("target", "rows", F.round("calls", 3).alias("calls"), F.round("seconds", 3).alias("seconds"))


def p2_hub_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rows and hit rate of every Hub; the rate is null where no row has a prediction and a class."""
    s = _debug_states(spark, d, "hub")
    rate = F.when(F.col("judged") > 0, F.round(F.col("hits") / F.col("judged"), 6))
    return s.select("hub", F.col("hub_rows").alias("rows"), rate.alias("hit_rate"))


def p2_hub_traffic(spark: SparkSession, d: str) -> DataFrame:
    """Per Hub, the join of debug with dynamobi on Target: joined rows, calls, seconds and hits, without forming it."""
    states = skew.eager_join(
        _target_states(spark, d).where("target is not null"),
        _debug_states(spark, d, "target", "hub").where("target is not null"),
        ["target"],
    )
    out = skew.joined_rollup(states, ["hub"], "rows", "hub_rows", ["calls", "seconds"], ["hits"])
    return out.select("hub", "joined_rows", F.round("calls", 3).alias("calls"), F.round("seconds", 3).alias("seconds"), "hits")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "dynamobi").where("Class = 1")
    return c.select(
        "call_id", id_number("Source").alias("source"), id_number("Target").alias("target"), "Date", "loaded_at",
        amount("Calls").alias("calls"), amount("duration").alias("duration"), "some", "rate", "split", "feed",
    )


MEASURES = ["calls", "duration"]
CONTENT = ["target", "Date", "calls", "duration", "some", "rate"]  # rows of a caller that agree in these are re-deliveries


def _trees(spark: SparkSession, d: str) -> DataFrame:
    leaves = rolling.daily_leaves(_calls(spark, d), "source", "Date", MEASURES, CONTENT)
    return cut(rolling.tree_rows(leaves, "source", MEASURES))


def p3_trailing(spark: SparkSession, d: str) -> DataFrame:
    return rolling.trailing(_trees(spark, d), "source", MEASURES, windows=(7, 30))


def _flat(trees: DataFrame) -> DataFrame:
    t = rolling.tree_nodes(trees, "source")
    return t.select("source", "shard", "level", "pos", *[F.round(c, 3).alias(c) if c.endswith("_sum") else F.col(c) for c in t.columns[4:]])


def p3_tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The stored trees node by node: per caller, shard, level and position the sums and counts."""
    return _flat(_trees(spark, d))


def p3_late_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The stored trees of rows that arrived within a day, then corrected by those that came later.

    A late copy of a row that came in time is a re-delivery and corrects nothing.
    """
    once = cut(rolling.first_deliveries(_calls(spark, d), "source", "Date", MEASURES, CONTENT, "loaded_at"))
    late = F.coalesce(F.col("loaded_at") > F.col("Date") + F.expr("interval 1 day"), F.lit(False))
    base, delta = (rolling.tree_rows(rolling.daily_leaves(once.where(c), "source", "Date", MEASURES), "source", MEASURES) for c in (~late, late))
    path = scratch(spark)
    rolling.store_trees(base, path, "source")
    rolling.correct_store(spark, path, delta, "source", MEASURES)
    return _flat(rolling.stored_trees(spark, path, "source", MEASURES))


QUERIES = {
    "p2_found": p2_found,
    "p2_target_load": p2_target_load,
    "p2_hub_rates": p2_hub_rates,
    "p2_hub_traffic": p2_hub_traffic,
    "p3_trailing": p3_trailing,
    "p3_tree_nodes": p3_tree_nodes,
    "p3_late_corrections": p3_late_corrections,
}

_T = f'{sql_id_number("\"Target\"")}'
_S = f'{sql_id_number("\"Source\"")}'
_DYN = f"""dyn as (select {_T} target, count(*) n, coalesce(sum({sql_amount('"Calls"')}), 0) calls,
    coalesce(sum({sql_amount('"duration"')}), 0) as seconds from dynamobi group by 1)"""

_CALLS = f"""calls as (select call_id, {_S} source, {_T} target, "Date" ts, {sql_amount('"Calls"')} calls,
    {sql_amount('"duration"')} duration, "some" s1, "rate" r1 from dynamobi where "Class" = 1)"""

_TREE = f"""with {_CALLS},
once as (select distinct source, target, ts, calls, duration, s1, r1 from calls where source is not null and ts is not null),
leaf as (select source, datediff('day', date '1970-01-01', cast(ts as date)) dy, count(*) n, coalesce(sum(calls), 0) cs,
    count(calls) cn, coalesce(sum(duration), 0) ds, count(duration) dn from once group by all),
lv as (select unnest(range(0, {rolling.LEVELS} + 1)) level)
select source, cast(dy // {rolling.SHARD} as int) shard, cast(level as int) as level, cast((dy % {rolling.SHARD}) // cast(pow(2, level) as int) as int) pos,
    cast(sum(n) as bigint) n_rows, round(sum(cs), 3) calls_sum, cast(sum(cn) as bigint) calls_n,
    round(sum(ds), 3) duration_sum, cast(sum(dn) as bigint) duration_n
from leaf, lv group by all"""


def _trailing_sql() -> str:
    def frame(k: int) -> str:
        return f"over (partition by source order by dy rows between {k - 1} preceding and current row)"

    cols = []
    for k in (7, 30):
        cols.append(f"cast(sum(n) {frame(k)} as bigint) n_rows_{k}")
        for c in ("calls", "duration"):
            cols.append(f"sum({c}) {frame(k)} {c}_sum_{k}")
            cols.append(f"sum({c}) {frame(k)} / count(*) {frame(k)} {c}_day_avg_{k}")
    return f"""with {_CALLS},
once as (select distinct source, target, ts, calls, duration, s1, r1 from calls where source is not null),
b as (select min(datediff('day', date '1970-01-01', cast(ts as date))) lo, max(datediff('day', date '1970-01-01', cast(ts as date))) hi from once),
days as (select unnest(range(lo, hi + 1)) dy from b),
leaf as (select source, datediff('day', date '1970-01-01', cast(ts as date)) dy, count(*) n, sum(calls) calls, sum(duration) duration
    from once where ts is not null group by all),
dense as (select s.source, d.dy, coalesce(n, 0) n, coalesce(calls, 0) calls, coalesce(duration, 0) duration
    from (select distinct source from once) s cross join days d left join leaf l on l.source = s.source and l.dy = d.dy)
select source, date '1970-01-01' + cast(dy as int) as "day", {', '.join(cols)} from dense"""


ORACLE = {
    "p2_found": f"""with {_DYN}, hb as (select "Hub" hub, count(*) n from debug group by 1)
select 'target' field, cast(target as varchar) as value from dyn where target is not null and n >= {HEAVY_SHARE} * (select sum(n) from dyn)
union all select 'hub', cast(hub as varchar) from hb where hub is not null and n >= {HEAVY_SHARE} * (select sum(n) from hb)""",
    "p2_target_load": f'with {_DYN} select target, n as "rows", round(calls, 3) calls, round(seconds, 3) as seconds from dyn',
    "p2_hub_rates": """select "Hub" hub, count(*) as "rows", round(avg(case when "Predicted" is not null and "Class" is not null
    then cast("Predicted" = "Class" as int) end), 6) hit_rate from debug group by 1""",
    "p2_hub_traffic": f"""with d as (select {_T} target, {sql_amount('"Calls"')} calls, {sql_amount('"duration"')} as seconds from dynamobi),
g as (select {_T} target, "Hub" hub, cast("Predicted" = "Class" as int) hit from debug)
select hub, count(*) joined_rows, round(coalesce(sum(calls), 0), 3) calls, round(coalesce(sum(seconds), 0), 3) as seconds,
    cast(coalesce(sum(hit), 0) as bigint) hits from g join d using (target) group by 1""",
    "p3_trailing": _trailing_sql(),
    "p3_tree_nodes": _TREE,
    "p3_late_corrections": _TREE,
}
