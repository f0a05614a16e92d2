"""Graphs that tasks hold give the rows of the joins, and are searched without tables in between."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from edgeloom import session
from edgeloom.operators import graph, held, walks
from edgeloom.plans import graph_queries


def _graphs(spark):
    rng = random.Random(7)
    e = {(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(200)} | {("n1", "n1"), ("x", "y")} | {(f"c{i}", f"c{i + 1}") for i in range(12)}
    return spark.createDataFrame(sorted(e), "Source string, Target string"), spark.createDataFrame([], "Source string, Target string")


def _both(monkeypatch, run):
    """The rows with the graph held, with the graph joined, and how many tables the former wrote."""
    before = len(session._written)
    a = run()
    tables = len(session._written) - before
    monkeypatch.setattr(held, "MAX_EDGES", -1)
    b = run()
    monkeypatch.undo()
    return a, b, tables


@pytest.mark.parametrize("words", [1, 8])
def test_reach_and_closeness(spark, monkeypatch, words):
    for df in _graphs(spark):
        for f in (graph.reachable_count, graph.closeness):
            monkeypatch.setattr(held, "WORDS", words)
            a, b, tables = _both(monkeypatch, lambda f=f, df=df: [(r[0], round(r[1], 9)) for r in sorted(f(df).collect())])
            assert a == b and tables <= 2  # the edges, and the sums of closeness; not a table per level


def test_agreement_writes_no_table_per_level_of_the_exact_search(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(i, i + 1) for i in range(10)], "Source int, Target int").write.parquet(str(tmp_path / "hepph_edges.parquet"))
    calls = []
    monkeypatch.setattr(graph, "cut", lambda df, real=graph.cut: calls.append(1) or real(df))
    monkeypatch.setattr(graph, "cut_counted", lambda df, *more, real=graph.cut_counted: calls.append(1) or real(df, *more))
    assert rows(graph_queries.reach_agreement(spark, str(tmp_path))) == [(11, 0, 0)]
    # the edges, two estimates of eleven rounds and a start, a few single tables; the exact searches took 26 more
    assert len(calls) <= 30


def test_path_counts_and_betweenness(spark, monkeypatch):
    for df in _graphs(spark):
        roots = graph.node_set(df).toDF("root").unionByName(spark.createDataFrame([("nowhere",), ("n1",)], "root string"))
        for kw in ({}, {"max_depth": 2}, {"reverse": True}):
            a, b, tables = _both(monkeypatch, lambda df=df, roots=roots, kw=kw: rows(graph.bfs_counts(df, roots, **kw)))
            assert a == b and tables == 1
        for k in (None, 3):
            a, b, tables = _both(monkeypatch, lambda df=df, k=k: [(r[0], round(r[1], 9)) for r in sorted(graph.betweenness(df, k).collect())])
            assert a == b and tables <= 4


def test_too_many_paths_are_an_error(spark):
    # 64 diamonds in a row: 2 ** 64 shortest paths
    e = [p for i in range(64) for p in ((f"{i}", f"{i}a"), (f"{i}", f"{i}b"), (f"{i}a", f"{i + 1}"), (f"{i}b", f"{i + 1}"))]
    df = spark.createDataFrame(e, "Source string, Target string")
    with pytest.raises(Exception, match="BIGINT"):
        graph.bfs_counts(df, spark.createDataFrame([("0",)], "root string")).collect()
    near = graph.bfs_counts(df, spark.createDataFrame([("2",)], "root string"))
    assert near.where("node = '64'").first().paths == 2**62


def test_propflow(spark, monkeypatch):
    for df in _graphs(spark):
        w = df.withColumn("w", (F.length("Source") * 3 + F.length("Target")).cast("double"))
        roots = graph.node_set(df).toDF("root").unionByName(spark.createDataFrame([("nowhere",)], "root string"))
        for kw in ({}, {"depth": 2, "weight": "w"}):
            a, b, tables = _both(monkeypatch, lambda w=w, roots=roots, kw=kw: [(r[0], round(r[1], 9)) for r in sorted(graph.propflow(w, roots, **kw).collect())])
            assert a == b and tables == 1


def test_max_flow(spark, monkeypatch):
    for df in _graphs(spark):
        ids = graph.node_set(df).limit(12)
        pairs = ids.toDF("Source").crossJoin(ids.toDF("Target")).unionByName(spark.createDataFrame([("nowhere", "n1"), ("n1", "nowhere"), ("c0", "c12")], "Source string, Target string"))
        a, b, tables = _both(monkeypatch, lambda df=df, pairs=pairs: rows(graph.max_flow(df, pairs)))
        assert a == b and tables <= 4


def test_max_flow_takes_paths_back(spark):
    # the path over m and k shuts both others out, unless it is taken back
    e = [("s", "m"), ("s", "x"), ("x", "k"), ("m", "k"), ("m", "y"), ("y", "t"), ("k", "t")]
    df = spark.createDataFrame(e, "Source string, Target string")
    assert rows(graph.max_flow(df, spark.createDataFrame([("s", "t")], "Source string, Target string"))) == [("s", "t", 2)]


@pytest.mark.parametrize("p,q", [(1, 1), (0.25, 2.0), (2.0, 0.5), (0.5, 1)])
def test_walks_are_those_of_the_joins(spark, monkeypatch, p, q):
    for df in _graphs(spark):
        a, b, tables = _both(monkeypatch, lambda df=df: rows(walks.node2vec_walks(df, 7, 2, p, q), "walk_id", "walk"))
        assert a == b and tables == 1


def test_walk_lengths_need_no_table_of_steps(spark, tmp_path):
    spark.createDataFrame([(str(i), str(i + 1), 1, 1) for i in range(30)], "Source string, Target string, X int, Date bigint").write.parquet(str(tmp_path / "youtube_growth.parquet"))
    for f, want in ((graph_queries.walk_len_hist, [(i, 10) for i in range(1, 32)]), (graph_queries.walk_avg_len, [(16.0,)])):
        before = len(session._written)
        assert sorted(rows(f(spark, str(tmp_path)))) == want
        assert len(session._written) - before == 1
