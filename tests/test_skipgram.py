import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import embed, skipgram


@pytest.fixture(scope="module")
def walks(spark):
    """Walks within one of two groups of 20 nodes each."""
    rng = random.Random(1)
    data = [([f"{g}{rng.randrange(20)}" for _ in range(rng.randrange(1, 12))],) for g in "ab" for _ in range(1600)]
    return spark.createDataFrame([*data, ([],), (None,), (["alone"],)], "walk array<string>")


def _vectors(df):
    return {r.node: np.array(r.emb) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 3])
def test_groups_are_told_apart_however_walks_come(walks, parts):
    """Vectors do not depend on the partitions of the walks, neither of one task nor of several, and nodes that meet are alike."""
    fit = {"size": 8, "iterations": 4, "partitions": parts}
    got = _vectors(embed.train_embedding(walks, **fit))
    again = _vectors(embed.train_embedding(walks.repartition(5).sortWithinPartitions(F.rand(7)), **fit))
    assert set(got) == {f"{g}{i}" for g in "ab" for i in range(20)} | {"alone"}
    assert all(len(v) == 8 and np.isfinite(v).all() and (v == again[k]).all() for k, v in got.items())
    unit = {k: v / np.linalg.norm(v) for k, v in got.items() if k != "alone"}
    mean = lambda a, b: np.mean([unit[x] @ unit[y] for x in unit for y in unit if x[0] == a and y[0] == b and x != y])
    assert min(mean("a", "a"), mean("b", "b")) > mean("a", "b") + 0.3


def test_a_task_for_each_part(spark):
    """Parts of one task each stay apart, so that fits run side by side and hold their own vectors only."""
    df = spark.range(40).select((F.col("id") % 4).cast("int").alias("home"), F.array(F.col("id").cast("string")).alias("walk"), F.col("id").alias("h"))

    def count(batches):
        homes = [h for b in batches for h in b.column("home").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([len(set(homes))], pa.int32()), pa.array([len(homes)], pa.int32())], ["homes", "rows"])

    seen = skipgram._inputs(df, None, 4).mapInArrow(count, "homes int, rows int").collect()
    assert [(r.homes, r["rows"]) for r in seen if r["rows"]] == [(1, 10)] * 4


def test_one_pass_moves_vectors_as_the_formula_says():
    """A walk of two nodes without noise: each goes a step towards the other's outer vector, by one minus the chance of the pair."""
    inner, outer = np.array([[1.0, 0.0], [0.0, 2.0]], np.float32), np.array([[0.5, 0.5], [1.0, -1.0]], np.float32)
    a, b = inner.copy(), outer.copy()
    skipgram.NEGATIVES, kept = 0, skipgram.NEGATIVES
    try:
        skipgram.fit(a, b, np.array([0, 1]), np.array([0, 2]), 1, np.random.default_rng(1), 0.0, 1.0)
    finally:
        skipgram.NEGATIVES = kept
    miss = lambda i, o: 1 - 1 / (1 + np.exp(-inner[i] @ outer[o]))
    want_in = inner + skipgram.RATE * np.array([miss(0, 1) * outer[1], miss(1, 0) * outer[0]])
    want_out = outer + skipgram.RATE * np.array([miss(1, 0) * inner[1], miss(0, 1) * inner[0]])
    assert np.allclose(a, want_in, atol=1e-6) and np.allclose(b, want_out, atol=1e-6)
