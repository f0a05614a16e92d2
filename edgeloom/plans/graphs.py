"""The graphs that queries run on, as DataFrames and as SQL: whole tables, no subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.ids import id_number, sql_id_text
from edgeloom.sources import edges as src
from edgeloom.sources.tables import load

KEY = ["Source", "Target"]


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Distinct call edges with the first Date."""
    return src.call_edges(load(spark, d, "dynamobi"))


def call_numbers(spark: SparkSession, d: str, split: str | None = None) -> DataFrame:
    """``calls`` with ids as BIGINT, of one split or of all."""
    rows = load(spark, d, "dynamobi")
    return src.call_edges(rows if split is None else rows.where(F.col("split") == split), numbers=True)


def as_text(df: DataFrame) -> DataFrame:
    """Id columns as strings again."""
    ids = ("Source", "Target", "node", "component")
    return df.select(*[F.col(c).cast("string").alias(c) if c in ids else F.col(c) for c in df.columns])


def test_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (Source, Target, Class) of the test rows, calls and non-edges; ids as BIGINT."""
    t = load(spark, d, "dynamobi").where("split = 'test'").select(id_number("Source").alias("Source"), id_number("Target").alias("Target"), "Class")
    return t.where("Source is not null and Target is not null").distinct()


def growth(spark: SparkSession, d: str) -> DataFrame:
    return src.growth_edges(load(spark, d, "youtube_growth"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct citation pairs; ids as strings."""
    e = load(spark, d, "hepph_edges").select(F.col("Source").cast("string").alias("Source"), F.col("Target").cast("string").alias("Target"))
    return e.where("Source is not null and Target is not null").distinct()


_S, _T = sql_id_text('"Source"'), sql_id_text('"Target"')
CTE = {
    "calls": f"""calls as (select s "Source", t "Target", min("Date") "Date", 1 "Class" from (select {_S} s, {_T} t, "Date" from dynamobi where "Class" = 1) q
        where s is not null and t is not null group by 1, 2)""",
    "tr": f"""tr as (select s "Source", t "Target", min("Date") "Date", 1 "Class" from (select {_S} s, {_T} t, "Date" from dynamobi where "Class" = 1 and split = 'train') q
        where s is not null and t is not null group by 1, 2)""",
    "tv": f"""tv as (select s "Source", t "Target", min("Date") "Date", 1 "Class" from (select {_S} s, {_T} t, "Date" from dynamobi where "Class" = 1 and split = 'test') q
        where s is not null and t is not null group by 1, 2)""",
    "te": f"""te as (select distinct s "Source", t "Target", "Class" from (select {_S} s, {_T} t, "Class" from dynamobi where split = 'test') q
        where s is not null and t is not null)""",
    "yt": """yt as (select "Source", "Target", min(make_timestamp("Date" * 1000000)) "Date", 1 "Class" from youtube_growth
        where "Source" is not null and "Target" is not null group by 1, 2)""",
    "hp": """hp as (select distinct cast("Source" as varchar) "Source", cast("Target" as varchar) "Target" from hepph_edges
        where "Source" is not null and "Target" is not null)""",
    # train nodes and predictable test pairs
    "trn": 'trn as (select "Source" v from tr union select "Target" from tr)',
    "ft": """ft as (select * from te where "Source" in (select v from trn) and "Target" in (select v from trn)
        and not exists (select 1 from tr where tr."Source" = te."Source" and tr."Target" = te."Target"))""",
}


def with_(*names: str, more: str = "") -> str:
    return "with recursive " + ", ".join(CTE[n] for n in names) + (", " + more if more else "") + " "


def sql_nodes(e: str) -> str:
    return f'(select "Source" node from {e} union select "Target" from {e})'


def sql_degrees(e: str) -> str:
    """(node, i, o)."""
    return f"""(select node, cast(sum(i) as bigint) i, cast(sum(o) as bigint) o from (select "Target" node, 1 i, 0 o from (select distinct "Source", "Target" from {e})
        union all select "Source", 0, 1 from (select distinct "Source", "Target" from {e})) q group by 1)"""
