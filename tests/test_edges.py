import datetime as dt
import gzip
import hashlib
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from edgeloom.operators import order, report, sample, split
from edgeloom.plans import edge_queries
from edgeloom.sources import edges as src


def test_call_log_files(spark, tmp_path):
    for day, lines in (("07-01", ["2008-07-01 02:00:00,1,2,1,0,5,0.1", "2008-07-01 01:00:00,1,2,9,0,5,0.1", "2008-07-01 03:00:00,2,1,1,0,5,0.1"]), ("07-02", ["2008-07-02 01:00:00,1,2,1,0,5,0.1"])):
        with gzip.open(tmp_path / f"2008-{day}.txt.gz", "wt") as f:
            f.write("\n".join(lines))
    one = src.read_call_log(spark, str(tmp_path / "2008-07-01.txt.gz"))
    assert one.columns == ["Date", "Source", "Target", "Class"]
    assert rows(one, "Source", "Target", "Date") == [("1", "2", dt.datetime(2008, 7, 1, 1)), ("2", "1", dt.datetime(2008, 7, 1, 3))]
    both = src.read_call_log(spark, str(tmp_path / "*.txt.gz"), day_from_name=True)
    assert rows(both.groupBy("day").count()) == [("07-01", 2), ("07-02", 1)]


def test_citation_files(spark, tmp_path):
    (tmp_path / "e").write_text("# From\tTo\n1\t2\n1\t2\n7\t1\n")
    (tmp_path / "d").write_text("# id\tdate\n0000001\t1992-03-06\nx\t1992-01-01\n")
    e = src.read_citations(spark, str(tmp_path / "e"), str(tmp_path / "d"))
    assert rows(e, "Source", "Target", "Date") == [("1", "2", dt.datetime(1992, 3, 6))] * 2


def test_other_files(spark, tmp_path):
    (tmp_path / "s").write_text("1 2\n1 2\n2 1\n")
    assert rows(src.read_social(spark, str(tmp_path / "s"))) == [(1, "1", "2", 1), (1, "2", "1", 1)]
    (tmp_path / "g").write_text("% c\n1 2 1 200\n1 2 1 100\n3 4 1 \n")
    g = src.read_growth(spark, str(tmp_path / "g"))
    assert rows(g, "Source", "Target", "Date") == [("1", "2", dt.datetime(1970, 1, 1, 0, 1, 40)), ("3", "4", None)]
    (tmp_path / "f").write_text("% c\n1 2\n1 2\n")
    assert rows(src.read_friendships(spark, str(tmp_path / "f"))) == [(None, "1", "2", 1)] * 2


def test_dedup_first_orders_nulls_last(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", 5, 2), ("k", 3, 9), ("k", 3, 8), (None, None, None)], "key string, a int, b int")
    assert rows(src.dedup_first(df, ["key"], [F.col("a")])) == [("k", 3, 8), (None, None, None)]


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, None, 2)], "Class int, f int, g int")
    assert src.move_last(df, "Class").columns == ["f", "g", "Class"]
    assert rows(src.zero_fill(df, ["f"])) == [(1, 0, 2)]


def test_global_rank_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    r = order.global_rank(df, ["v"]).collect()
    assert sorted((x.v, x.rn) for x in r) == [(i, i + 1) for i in range(1000)]
    assert order.global_rank(df.where("false"), ["v"]).count() == 0


def test_splits(spark):
    e = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(10)], "Source string, Target string")
    s = order.fraction_split(e, ["Source"], 0.37)
    assert rows(s.groupBy("part").count()) == [("test", 7), ("train", 3)]
    assert order.fraction_split(e, ["Source"], 0.3, cap=2).count() == 5
    train = spark.createDataFrame([("a", "b"), ("b", "c")], "Source string, Target string")
    test = spark.createDataFrame([("a", "b"), ("c", "a"), ("c", "a"), ("a", "z"), (None, "a")], "Source string, Target string")
    assert rows(split.filter_test(train, test)) == [("c", "a"), ("c", "a")]
    assert rows(split.known_nodes(test, train)) == [("a", "b"), ("c", "a"), ("c", "a")]
    assert rows(split.induced(train, spark.createDataFrame([("a",), ("b",)], "node string"))) == [("a", "b")]
    assert rows(split.edge_subgraph(train, test)) == [("a", "b")]


def test_capped_split_keeps_the_window(spark, tmp_path):
    e = spark.range(1000).selectExpr("cast(id as string) Source", "cast(id + 1 as string) Target", "id Date")
    e.write.parquet(str(tmp_path / "youtube_growth.parquet"))
    assert rows(edge_queries.capped_split(spark, str(tmp_path)).groupBy("part").count()) == [("test", 750), ("train", 250)]


@pytest.mark.parametrize("small", [1, 7, 100_000])
def test_among_first_is_the_head_of_the_order(spark, monkeypatch, small):
    monkeypatch.setattr(order, "SMALL", small)
    rng = random.Random(small)
    data = [(rng.choice([None, 1, 2, 2, 5, 10**12]), str(i), rng.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(data, "v bigint, k string, x int")
    value = F.coalesce("v", F.lit(1 << 60))
    want = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for n in (0, 1, 57, 150, 299, 300, 1000):
        assert rows(df.where(order.among_first(df, value, ["k"], n))) == sorted(want[:n], key=repr)
    assert df.where("false").where(order.among_first(df.where("false"), value, ["k"], 3)).count() == 0
    copies = spark.createDataFrame([(1, "a")] * 3 + [(2, "b")], "v bigint, k string")
    assert copies.where(order.among_first(copies, F.col("v"), ["k"], 2)).count() == 3  # ties with the last row are in


def test_time_order_has_null_dates_last(spark):
    t = dt.datetime(2008, 7, 1)
    data = [(None, "a", "b"), (t + dt.timedelta(seconds=1), "c", "d"), (t, "e", "f"), (t, "a", "z"), (t + dt.timedelta(microseconds=1), "a", "a")]
    df = spark.createDataFrame([(*r, 1) for r in data], "Date timestamp_ntz, Source string, Target string, Class int")
    want = sorted(data, key=lambda r: (r[0] is None, r[0] or t, r[1], r[2]))
    for n in range(6):
        assert rows(sample.sample_time(df, n), "Date", "Source", "Target") == sorted(want[:n], key=repr)
    parts = {r.Source + r.Target: r.part for r in order.fraction_split(df, share=0.4, **order.by_time("Date", "Source", "Target")).collect()}
    assert sorted(k for k, p in parts.items() if p == "train") == sorted(s + x for _, s, x in want[:2])


def test_quartiles(spark):
    rng = random.Random(5)
    a, b = [float(rng.randrange(9)) for _ in range(41)], [rng.random() for _ in range(40)]
    df = spark.createDataFrame([(a[i] if i < 41 else None, b[i] if i < 40 else None, None) for i in range(45)], "a double, b double, c double")
    got = {r.column: r for r in report.describe(df, ["a", "b", "c"]).collect()}
    for k, v in (("a", a), ("b", b)):
        import numpy as np

        assert (got[k].n, got[k].min, got[k].max) == (len(v), min(v), max(v))
        assert [got[k].q25, got[k].q50, got[k].q75] == pytest.approx(list(np.quantile(v, [0.25, 0.5, 0.75])), abs=1e-6)
        assert (got[k].mean, got[k].std) == pytest.approx((np.mean(v), np.std(v, ddof=1)), abs=1e-6)
    assert (got["c"].n, got["c"].mean, got["c"].q50) == (0, None, None)
    assert report.describe(df.where("false"), ["a"]).count() == 0


@pytest.mark.parametrize("method", ["bfs", "dfs"])
def test_full_traversal_by_brute_force(spark, method):
    rng = random.Random(3)
    e = {(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(120)} | {("x", "x")}
    df = spark.createDataFrame(sorted(e), "Source string, Target string").withColumn("Class", F.lit(1))
    key = lambda n: (hashlib.md5(f"42|{n}".encode()).hexdigest(), n)
    nodes = sorted({x for p in e for x in p}, key=key)
    after = {n: sorted(t for s, t in e if s == n) for n in nodes}

    def visit(size):
        seen, got, roots, at = [], 0, 1, 0
        if method == "dfs":
            for r in nodes:
                stack = [r]
                while stack and got < size:
                    n = stack.pop()
                    if n not in seen:
                        seen.append(n)
                        got += len(after[n])
                        stack += [t for t in after[n] if t not in seen]
            return seen
        level = nodes[:1]
        while True:
            for n in sorted(level):
                seen.append(n)
                got += len(after[n])
                if got >= size:
                    return seen
            level = sorted({t for n in level for t in after[n]} - set(seen))
            while not level:
                at, roots = at + roots, min(2 * roots, len(nodes))
                level = [n for n in nodes[at : at + roots] if n not in seen]

    for size in (1, 30, 90, len(e) - 1):
        kept = set(visit(size))
        assert rows(sample.sample_search(df, size, method), "Source", "Target") == sorted((s, t) for s, t in e if s in kept)
    assert sample.sample_search(df, len(e), method).count() == len(e) and sample.sample_search(df, 0, method).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        sample.sample_search(df, 1, "none")
    with pytest.raises(ValueError, match="at most"):
        sample.sample_search(df, 1, "dfs", limit=5)
