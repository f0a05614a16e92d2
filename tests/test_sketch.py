"""Estimates of reach in slices of registers: against exact counts, whole at any width, and without a table per round."""

import random

import numpy as np
import pytest
from conftest import rows

from edgeloom import session
from edgeloom.operators import graph, sketch


def _edges(spark, n, m, seed):
    rng = random.Random(seed)
    e = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(10**6 + i, 10**6 + i + 1) for i in range(30)} | {(10**7, i) for i in range(60)} | {(5, 5)}
    return spark.createDataFrame(sorted(e), "Source bigint, Target bigint")


def test_no_table_per_round(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "Source int, Target int")
    before = len(session._written)
    got = rows(graph.reach_estimates(chain))
    assert got == sorted(((i, 41 - i, sum(range(41 - i))) for i in range(41)), key=repr)
    assert len(session._written) - before <= 5  # one per round, of all sketches, before


@pytest.mark.parametrize("cells", [10**9, 170_000, 50_000])
def test_estimates_are_near_the_exact_counts(spark, monkeypatch, cells):
    df = _edges(spark, 3000, 6000, 3)
    monkeypatch.setattr(sketch, "MAX_CELLS", cells)
    exact = {r.node: r for r in graph._reach_sums(graph.as_graph(df)).collect()}
    got = {r.node: r for r in graph.reach_estimates(df).collect()}
    assert set(got) == set(exact) and max(r.r for r in exact.values()) > 1000
    for v, x in exact.items():
        if x.r < sketch.SMALL:
            assert (got[v].reached, got[v].distance_sum) == (x.r + 1, x.d)
        else:
            assert abs(got[v].reached / (x.r + 1) - 1) < 5 * 1.04 / 64 and abs(got[v].distance_sum / x.d - 1) < 5 * 1.04 / 64


def test_too_many_nodes_are_joined(spark, monkeypatch):
    df = _edges(spark, 40, 80, 4)
    a = rows(graph.reach_estimates(df))
    monkeypatch.setattr(sketch, "MAX_CELLS", 10)
    assert rows(graph.reach_estimates(df)) == a


def test_unions_whatever_is_taken_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = (np.concatenate([rng.integers(0, 90, 300), np.full(70, 3), np.full(50, 85)]).astype(np.int32) for _ in "ab")
    b = rng.integers(0, 60, len(a)).astype(np.int32)
    h = sketch._Inner(a, b, 60, 90)
    r = rng.integers(0, 40, (60, 16)).astype(np.uint8)
    want = {h.place[v]: r[h.place[np.unique(b[a == v])]].max(0) for v in np.unique(a)}
    for deep, edges in ((32, 1 << 15), (4, 8), (200, 8)):
        monkeypatch.setattr(sketch, "DEEP", deep)
        monkeypatch.setattr(sketch, "EDGES", edges)
        for v in (h.linked[h.linked < 60], h.linked[h.linked >= 60]):
            assert all((x == want[i]).all() for i, x in zip(v, sketch._union(r, h, v), strict=True))
