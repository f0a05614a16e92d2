from collections import Counter

from conftest import rows
from pyspark.sql import functions as F

from edgeloom.operators import skew

L = [("k", 1.0), ("k", 2.0), ("k", None), ("m", 5.0), (None, 7.0), (None, 1.0)]
R = [("k", 1, 1), ("k", 2, 0), ("k", 2, 1), (None, 3, 1), ("z", 3, None)]


def _states(spark):
    left = spark.createDataFrame(L, "key string, v double").withColumn("rows", F.lit("clash"))
    right = spark.createDataFrame(R, "key string, hub int, hit int").withColumn("v", F.lit("clash"))
    return (
        skew.keyed_states(left, {"key": F.col("key")}, {"v": F.col("v")}),
        skew.keyed_states(right, {"key": F.col("key"), "hub": F.col("hub")}, {"hit": F.col("hit")}, rows="hub_rows"),
    )


def test_rollup_equals_the_formed_join(spark):
    a, b = _states(spark)
    got = rows(skew.joined_rollup(skew.eager_join(a, b, ["key"]), ["hub"], "rows", "hub_rows", ["v"], ["hit"]))
    n, v, h = Counter(), Counter(), Counter()
    for k, x in L:
        for k2, hub, hit in R:
            if k == k2:
                n[hub] += 1
                v[hub] += x or 0
                h[hub] += hit or 0
    assert got == sorted(((k, n[k], v[k], h[k]) for k in n), key=repr)


def test_heavy_values_and_null_keys(spark):
    a, b = _states(spark)
    got = rows(skew.heavy_values(skew.eager_join(a, b, ["key"], "full"), ("key", "rows"), ("hub", "hub_rows"), 0.4))
    # of 6 rows k has 3; of 5 hub rows 2 has 2, 3 has 2; nulls count in the totals but are no values
    assert got == [("hub", "2"), ("hub", "3"), ("key", "k")]


def test_empty(spark):
    e = spark.createDataFrame([], "key string, v double")
    s = skew.keyed_states(e, {"key": F.col("key")}, {"v": F.col("v")})
    assert s.count() == 0
    t = skew.keyed_states(e, {"key": F.col("key"), "g": F.col("v")}, {}, rows="m")
    assert skew.heavy_values(skew.eager_join(s, t, ["key"], "full"), ("key", "rows"), ("g", "m"), 0.1).count() == 0


def test_hot_key(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("key"), F.lit(1.0).alias("v"))
    s = skew.keyed_states(df, {"key": F.col("key")}, {"v": F.col("v")})
    hot = s.where("key = 0").first()
    assert (hot["rows"], hot["v"]) == (10_000, 10_000.0)
