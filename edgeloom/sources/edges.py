"""Edge tables: explicit schemas, raw-file readers, and the canonical [Date, Source, Target, Class] projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.hashing import key_hash
from edgeloom.functions.ids import id_number

CALL_LOG = "Date timestamp_ntz, Source string, Target string, Calls string, some string, duration string, rate string"
CITATION_EDGES = "Source string, Target string"
CITATION_DATES = "Source string, Date timestamp_ntz"
SOCIAL = "Source string, Target string"
GROWTH = "Source string, Target string, X int, Date bigint"


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (nulls last), then by all columns.

    A min over structs, so copies are combined before the shuffle and a hot key costs one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = [x for o in order for x in (o.isNull(), o)] + [x for c in rest for x in (F.col(c).isNull(), F.col(c))]
    best = F.min(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.struct(*rest).alias("row"))).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.row.{c}").alias(c) for c in rest]).select(*df.columns)


def canonical(df: DataFrame) -> DataFrame:
    """Prune to [Date, Source, Target, Class]."""
    return df.select("Date", "Source", "Target", "Class")


def read_call_log(spark: SparkSession, path: str | list[str], day_from_name: bool = False) -> DataFrame:
    """Headerless call log, gzip or plain, one file or a glob; deduplicated edges with Class 1.

    With ``day_from_name`` the rows keep a ``day`` column (MM-DD) taken from the file name, so that one scan of many
    files replaces a loop over them, and edges are distinct per day.
    """
    df = spark.read.schema(CALL_LOG).csv(path)
    if day_from_name:
        df = df.withColumn("day", F.regexp_extract(F.col("_metadata.file_name"), r"(?:^|\D)(\d{2}-\d{2})(?:\D|$)", 1))
    keys = ["Source", "Target"] + (["day"] if day_from_name else [])
    out = dedup_first(df.select("Date", *keys), keys, [F.col("Date")]).withColumn("Class", F.lit(1))
    return out if day_from_name else canonical(out)


def read_citations(spark: SparkSession, edges: str, dates: str) -> DataFrame:
    e = spark.read.schema(CITATION_EDGES).option("sep", "\t").option("comment", "#").csv(edges)
    d = spark.read.schema(CITATION_DATES).option("sep", "\t").option("comment", "#").csv(dates)
    return citation_edges(e, d)


def read_social(spark: SparkSession, path: str, seed: int = 42) -> DataFrame:
    """Space-separated pairs without dates: Date is the constant 1, copies removed, in a seeded random order."""
    df = spark.read.schema(SOCIAL).option("sep", " ").csv(path)
    return social_edges(df).orderBy(key_hash(seed, "Source", "Target"), "Source", "Target")


def read_growth(spark: SparkSession, path: str) -> DataFrame:
    return growth_edges(spark.read.schema(GROWTH).option("sep", " ").option("comment", "%").csv(path))


def read_friendships(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated pairs with % comments; no date, copies kept."""
    df = spark.read.schema(SOCIAL).option("sep", " ").option("comment", "%").csv(path)
    return df.select(F.lit(None).cast("timestamp_ntz").alias("Date"), "Source", "Target", F.lit(1).alias("Class"))


def call_edges(df: DataFrame, numbers: bool = False) -> DataFrame:
    """Distinct call edges of a table with the call-log columns: Date of the first call of each pair, canonical ids.

    Rows of Class 0 are no calls; rows without a readable id are left out. The ids are grouped as numbers, half the
    bytes of their text in the shuffle; with ``numbers`` they stay so, for graph work.
    """
    rows = df.where("Class = 1").select("Date", id_number("Source").alias("s"), id_number("Target").alias("t"))
    e = rows.where("s is not null and t is not null").groupBy("s", "t").agg(F.min("Date").alias("Date"))
    kind = "bigint" if numbers else "string"
    return e.select("Date", F.col("s").cast(kind).alias("Source"), F.col("t").cast(kind).alias("Target"), F.lit(1).alias("Class"))


def citation_edges(edges: DataFrame, dates: DataFrame) -> DataFrame:
    """Edges with the date of their Source; ids compared as integers, edges without a date left out, copies kept."""
    e = edges.select(F.col("Source").try_cast("int").alias("i"), F.col("Target").cast("string").alias("Target"))
    d = dates.select(F.col("Source").try_cast("int").alias("i"), "Date")
    return e.join(d, "i").select("Date", F.col("i").cast("string").alias("Source"), "Target", F.lit(1).alias("Class"))


def social_edges(df: DataFrame) -> DataFrame:
    return df.select(F.lit(1).alias("Date"), "Source", "Target", F.lit(1).alias("Class")).distinct()


def growth_edges(df: DataFrame) -> DataFrame:
    """Epoch seconds to timestamps; the earliest row of each pair survives, a pair without any date keeps null."""
    ts = F.timestamp_seconds("Date").cast("timestamp_ntz")
    rows = df.where("Source is not null and Target is not null").select(ts.alias("Date"), "Source", "Target")
    return rows.groupBy("Source", "Target").agg(F.min("Date").alias("Date")).select("Date", "Source", "Target", F.lit(1).alias("Class"))


def move_last(df: DataFrame, column: str) -> DataFrame:
    """The label column moved to the end."""
    return df.select(*[c for c in df.columns if c != column], column)


def zero_fill(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Nulls of the named features to 0; keys and Date stay as they are."""
    return df.fillna(0, subset=list(features))
