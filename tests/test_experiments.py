import random
import threading

import pytest
from conftest import rows
from pyspark.sql import functions as F

from edgeloom.functions import moments
from edgeloom.operators import graph
from edgeloom.operators.split import KEY
from edgeloom.plans import experiments as ex
from edgeloom.sources import generators
from edgeloom.session import cut

SMALL = {"trees": 3, "depth": 4, "size": 4, "walk_length": 4, "num_walks": 1, "iterations": 1}


@pytest.fixture(scope="module")
def edges(spark):
    g = generators.gnp_digraph(spark, 50, 0.12, seed=3)
    return cut(g.withColumn("Date", F.timestamp_seconds(F.crc32(F.concat("Source", "Target"))).cast("timestamp_ntz")))


def _flow(e, s, t):
    """Ford-Fulkerson on unit capacities."""
    used, n = set(), 0
    while True:
        prev, q = {s: None}, [s]
        for u in q:
            for a, b in e:
                if a == u and (a, b) not in used and b not in prev:
                    prev[b] = (a, b)
                    q.append(b)
                if b == u and (a, b) in used and a not in prev:
                    prev[a] = (a, b)
                    q.append(a)
        if t not in prev:
            return n
        n, x = n + 1, t
        while prev[x]:
            a, b = prev[x]
            if b == x:
                used.add((a, b))
                x = a
            else:
                used.discard((a, b))
                x = b


def test_max_flow(spark):
    rng = random.Random(4)
    e = {(str(rng.randrange(9)), str(rng.randrange(9))) for _ in range(30)}
    p = [("0", "1"), ("2", "7"), ("3", "5"), ("8", "0"), ("4", "4"), ("0", "zz"), ("0", "1")]
    df = spark.createDataFrame(sorted(e), "Source string, Target string")
    got = rows(graph.max_flow(df, spark.createDataFrame(p, "Source string, Target string")))
    loose = {x for x in e if x[0] != x[1]}
    assert got == sorted({(s, t, None if s == t else _flow(loose, s, t)) for s, t in p}, key=repr)


@pytest.mark.parametrize("family", ex.FAMILIES)
def test_families(edges, family):
    kw = {k: v for k, v in SMALL.items() if family != "heuristic" or k in ("trees", "depth")}
    n = edges.count() // 2
    r = ex.sweep_sizes(edges, [n], families=[family], **({"with_katz": False} if family == "heuristic" else {}), **kw).collect()
    assert [(x.method, x.model, x["size"]) for x in r] == [(family, "rf", n)]
    assert all(0 <= x.roc_auc <= 1 for x in r)


def test_days_and_buckets(edges):
    e = edges.withColumn("day", F.concat(F.lit("07-0"), F.dayofmonth("Date") % 3))
    kw = {"with_katz": False, "trees": 3, "depth": 4}
    first = e.groupBy("day").count().orderBy(F.desc("count")).first()
    r = ex.train_one_day(e, first.day, first["count"], **kw).collect()
    assert {x.day for x in r} <= {"07-00", "07-01", "07-02"} - {first.day} and r
    b = ex.error_buckets(edges, [edges.count() // 2], ["heuristic"], **kw)
    assert b.columns == ["Size", "Method", "Split", "Common", "Hub", "pct_common_0", "NUnique"]
    assert {"POS", "NEG"} & {x.Split for x in b.collect()}
    with pytest.raises(ValueError, match="family"):
        ex.family_features(edges, edges, "none")


def test_grid_and_random_graphs(spark, edges):
    train = edges.select(*KEY, "Class")
    neg = train.select(F.col("Target").alias("Source"), F.col("Source").alias("Target"), F.lit(0).alias("Class"))
    g = ex.node2vec_grid(train.unionByName(neg), train.unionByName(neg), [0.25, 1], **SMALL)
    assert rows(g, "p", "q") == [(0.25, 1.0), (1.0, 1.0)]
    assert rows(ex.random_graph_metrics(spark, [20, 40], 0.1), "size") == [(20,), (40,)]
    ex.show_quality(g)


def test_moments(spark):
    df = spark.range(50).select(moments.random_moment("2008-07-01", "2008-08-01", 1, "id").alias("m"), moments.epoch_now().alias("n"), moments.day_of_path(F.lit("/data/x/2008-07-28.txt.gz")).alias("d"))
    assert df.where("m < '2008-07-01' or m >= '2008-08-01' or n not rlike '^[0-9]{10}$' or d <> '07-28'").count() == 0


def test_equal_walks_are_fitted_once(edges, monkeypatch):
    """With p = q = 1 node2vec and deepwalk have the same walks: one fit for both, the same figures; other p have their own."""
    fits = []
    monkeypatch.setattr(ex.embed, "train_embedding", lambda *a, real=ex.embed.train_embedding, **kw: fits.append(1) or real(*a, **kw))
    both = ["node2vec", "deepwalk"]
    got = ex.sweep_sizes(edges, [150], families=both, **SMALL).collect()
    assert len(fits) == 1 and [r.method for r in got] == both and tuple(got[0])[3:] == tuple(got[1])[3:]
    assert {r.Method for r in ex.error_buckets(edges, [150], both, **SMALL).collect()} == set(both) and len(fits) == 2
    assert ex._walked("node2vec", p=0.5) == "node2vec" and ex._walked("heuristic", p=1.0) == "heuristic"


def test_grid_fits_side_by_side(edges, monkeypatch):
    """Settings are fitted at the same time, on one graph, and have the rows of one after the other; vectors too large for that take turns."""
    train = edges.select(*KEY, "Class")
    neg = train.select(F.col("Target").alias("Source"), F.col("Source").alias("Target"), F.lit(0).alias("Class"))
    both = cut(train.unionByName(neg))
    meet, graphs = threading.Barrier(2), []

    def waits(*a, real=ex.embed.train_embedding, **kw):
        meet.wait(60)  # broken unless both get here
        return real(*a, **kw)

    monkeypatch.setattr(ex, "Graph", lambda *a, real=ex.Graph: graphs.append(1) or real(*a))
    monkeypatch.setattr(ex.embed, "train_embedding", waits)
    keys = ("size", "model", "method", "p", "q")
    got = rows(ex.node2vec_grid(both, both, [0.25, 1], **SMALL), *keys)
    assert len(graphs) == 1 and [r[3:] for r in got] == [(0.25, 1.0), (1.0, 1.0)]
    monkeypatch.undo()
    monkeypatch.setattr(ex, "SIDE_BY_SIDE", 0)
    running = []

    def alone(*a, real=ex.embed.train_embedding, **kw):
        assert not running
        running.append(1)
        out = real(*a, **kw)
        running.pop()
        return out

    monkeypatch.setattr(ex.embed, "train_embedding", alone)
    assert got == rows(ex.node2vec_grid(both, both, [0.25, 1], **SMALL), *keys)
