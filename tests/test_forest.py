"""Forests grown by tasks that hold all rows."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from edgeloom.operators import forest, model


def _frame(spark, n=3000, parts=4):
    d = spark.range(0, n, 1, parts).select(*[F.round(F.randn(i), 3).alias(f"f{i}") for i in range(5)], F.col("id").alias("Source"))
    return d.withColumn("Class", (F.col("f0") + F.col("f1") * F.col("f1") > 0.7).cast("int")).localCheckpoint()


def test_deep_forests_move_rows_not_histograms_of_nodes(spark, monkeypatch):
    d = _frame(spark)
    monkeypatch.setattr(model, "RandomForestClassifier", None)  # Spark's gathers every bin of every node from every partition
    names = [f"f{i}" for i in range(5)]
    got = model.fit_predict(d.where("Source % 3 > 0"), d.where("Source % 3 = 0"), names)
    assert got.columns == [*d.columns, "Predicted", "Probability"] and got.count() == 1000
    assert got.where("Predicted = Class").count() > 930
    assert got.where("Predicted <> cast(Probability > 0.5 as int) or Probability not between 0 and 1").count() == 0


def test_forests_do_not_depend_on_partitions(spark):
    d, names = _frame(spark), [f"f{i}" for i in range(5)]
    a, b = (rows(model.fit_predict(x, d, names, trees=5, depth=6), "Source", "Probability") for x in (d.repartition(1), d.repartition(7, "f2")))
    assert a == b


def test_as_good_as_sparks_forest(spark, monkeypatch):
    d, names = _frame(spark), [f"f{i}" for i in range(5)]
    fit, rest = d.where("Source % 3 > 0"), d.where("Source % 3 = 0")
    mine = model.fit_predict(fit, rest, names).where("Predicted = Class").count()
    monkeypatch.setattr(forest, "MAX_CELLS", 0)
    theirs = model.fit_predict(fit, rest, names).where("Predicted = Class").count()
    assert abs(mine - theirs) <= 20


@pytest.mark.parametrize("many", [1, 10**9])
def test_both_ways_to_find_a_split_grow_the_same_tree(monkeypatch, many):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 32, (500, 9)).astype(np.uint8)
    y = ((x[:, 0] > 12) ^ (rng.random(500) < 0.2)).astype(np.int64)
    want = forest.grow(x, y, 20, [1])
    monkeypatch.setattr(forest, "MANY", many)
    monkeypatch.setattr(forest, "BLOCK", 37)
    got = forest.grow(x, y, 20, [1])
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    # every split is the best one of some feature: a stump on the telling feature cuts where the classes do
    stump = forest.grow(x[:, :1], y, 1, [2])
    assert stump[1][0] == 12 and stump[2][0] == 1 and stump[3][2] > 0.6 > 0.4 > stump[3][1]


def test_one_class_nulls_and_no_rows_to_apply_to(spark):
    d = spark.createDataFrame([(1.0, None, 1), (None, 2.0, 1)], "f double, g double, Class int")
    assert rows(model.fit_predict(d, d, ["f", "g"])) == [(0.0, 2.0, 1, 1, 1.0), (1.0, 0.0, 1, 1, 1.0)]
    assert model.fit_predict(d, d.where("false"), ["f", "g"]).count() == 0
