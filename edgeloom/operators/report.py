"""Result frames and sinks: tidy tables, reshapes, CSV and JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import order
from edgeloom.session import cut

QUALITY = "size bigint, model string, precision double, recall double, roc_auc double, accuracy double, f1_score double"
DAY_QUALITY = "day string, model string, method string, precision double, recall double, roc_auc double, accuracy double, f1_score double"
LINK_STATS = "Size bigint, Method string, Split string, Common double, Hub double, pct_common_0 double, NUnique bigint"


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def unpivot(df: DataFrame, key: str, columns: Sequence[str], name: str = "method", value: str = "value") -> DataFrame:
    """(key, method, value): one row per key and column."""
    return df.unpivot([key], list(columns), name, value)


def pivot(df: DataFrame, key: str, names: str, value: str, columns: Sequence[str]) -> DataFrame:
    """One column per listed name; values that are not listed are left out."""
    return df.groupBy(key).pivot(names, list(columns)).agg(F.first(value))


def transpose(df: DataFrame, index: str) -> DataFrame:
    """Rows to columns of a small frame (all of it passes through the planner)."""
    return df.transpose(df[index])


def write_results(df: DataFrame, path: str, resume: bool = False) -> None:
    """CSV with a header; ``resume`` appends instead of replacing."""
    df.write.mode("append" if resume else "overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str = QUALITY, header: bool = True) -> DataFrame:
    """Result rows, from files with or without a header line."""
    return spark.read.schema(schema).option("header", header).csv(path)


def write_metrics_json(df: DataFrame, key: str, path: str) -> None:
    """One JSON object {key: {metric: value}} of a frame with a row per key (a few rows, one file)."""
    rest = [c for c in df.columns if c != key]
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.struct(*rest))))
    df.agg(F.to_json(pairs).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_metrics_json(spark: SparkSession, path: str, fields: Mapping[str, str] | str = "map<string,double>") -> DataFrame:
    """(size, <fields>) or (size, metrics) from {size: {...}}; ``fields`` maps names to types, or is one value type."""
    kind = fields if isinstance(fields, str) else "struct<" + ",".join(f"`{k}`:{v}" for k, v in fields.items()) + ">"
    raw = spark.read.option("wholetext", True).text(path)
    m = raw.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("size", "m"))
    return m.select("size", F.col("m").alias("metrics")) if isinstance(fields, str) else m.select("size", "m.*")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, q25, q50, q75, max) of numeric columns; sample deviation, exact quartiles.

    Rows shrink to counts per distinct value at once; a quartile lies between the values at two ranks, found by running
    totals of those counts. A column without values has a row of nulls. Nulls do not count.
    """
    one = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    per = cut(one.groupBy("x.column", "x.v").agg(F.count(F.lit(1)).alias("k")))
    v, k = F.col("v"), F.when(F.col("v").isNotNull(), F.col("k")).otherwise(0)
    mean = per.groupBy("column").agg((F.sum(v * k) / F.nullif(F.sum(k), F.lit(0))).alias("m"))
    # a row per column
    stats = per.join(F.broadcast(mean), "column").groupBy("column").agg(
        F.sum(k).alias("n"), F.round(F.first("m"), 6).alias("mean"),
        F.round(F.sqrt(F.sum(k * (v - F.col("m")) * (v - F.col("m"))) / F.nullif(F.sum(k) - 1, F.lit(0))), 6).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    ranked = order.running_total(order.global_rank(per.where("v is not null"), ["column", "v"], "rn"), "k")
    before = ranked.groupBy("column").agg(F.min(F.col("total") - F.col("k")).alias("start"), F.sum("k").alias("size"))
    ranked = ranked.join(F.broadcast(before), "column").select("column", "v", "size", (F.col("total") - F.col("start") - F.col("k")).alias("lo"), (F.col("total") - F.col("start") - 1).alias("hi"))
    aggs = []
    for q in (25, 50, 75):
        at = (F.col("size") - 1) * F.lit(q / 100)
        low = F.max(F.when(F.floor(at).between(F.col("lo"), F.col("hi")), F.col("v")))
        high = F.max(F.when(F.ceil(at).between(F.col("lo"), F.col("hi")), F.col("v")))
        aggs.append(F.round(low + (high - low) * F.max(at - F.floor(at)), 6).alias(f"q{q}"))
    quartiles = ranked.groupBy("column").agg(*aggs)
    return stats.join(quartiles, "column", "left").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")
