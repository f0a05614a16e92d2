import pytest
from conftest import rows
from pyspark.sql import functions as F

from edgeloom.operators import embed, model, report, sample
from edgeloom.operators.split import KEY
from edgeloom.sources import generators
from edgeloom.streaming import ingest


@pytest.fixture(scope="module")
def edges(spark):
    g = generators.gnp_digraph(spark, 60, 0.08, seed=5)
    return g.withColumn("Date", F.timestamp_seconds(F.crc32(F.concat("Source", "Target"))).cast("timestamp_ntz"))


def test_gnp(spark):
    a, b = generators.gnp_digraph(spark, 200, 0.05, seed=1), generators.gnp_digraph(spark, 200, 0.05, seed=1).repartition(3)
    assert rows(a) == rows(b)
    assert a.where("Source = Target").count() == 0 and a.select(*KEY).distinct().count() == a.count()
    assert abs(a.count() - 200 * 199 * 0.05) < 5 * (200 * 199 * 0.05) ** 0.5
    assert generators.gnp_digraph(spark, 5, 1.0).count() == 20 and generators.gnp_digraph(spark, 5, 0.0).count() == 0


def test_other_generators(spark):
    m = generators.gaussian_matrix(spark, 50, 3)
    assert m.columns == ["0", "1", "2", "Class"] and m.count() == 50
    c = generators.token_corpus(spark, 5).collect()
    assert all(len(r.sentence) == 10 and all(len(t) == 4 and t.islower() for t in r.sentence) for r in c)


@pytest.mark.parametrize("how", ["time", "random", "node", "bfs", "dfs", "rw"])
def test_samplers(edges, how):
    n = edges.count()
    s = sample.sample_graph(edges, n // 4, how)
    got = rows(s, *KEY)
    assert set(got) <= set(rows(edges, *KEY)) and len(set(got)) == len(got)
    assert len(got) >= n // 4 if how in ("node", "bfs", "dfs") else len(got) == n // 4
    assert got == rows(sample.sample_graph(edges, n // 4, how), *KEY)


def test_walk_sample_reaches_its_size(spark):
    # every edge leads to a dead end: 64 starts meet at most 64 of them
    e = spark.range(300).select(F.col("id").cast("string").alias("Source"), F.lit("end").alias("Target"))
    assert sample.sample_walk(e, 90, restart=0.0, walkers=64, dead_ends=1).distinct().count() == 90
    # and a cycle of two never comes to a dead end: new starts come by restart
    e = spark.range(200).select(F.col("id").cast("string").alias("Source"), F.col("id").bitwiseXOR(F.lit(1)).cast("string").alias("Target"))
    assert sample.sample_walk(e, 150).distinct().count() == 150
    assert sample.sample_walk(e, 500).count() == 200
    with pytest.raises(RuntimeError):
        sample.sample_walk(e, 199, walkers=1, max_steps=3)


def test_unknown_sampler_keeps_all(edges):
    assert sample.sample_graph(edges, 3, "none").count() == edges.count()


def test_negatives(spark, edges):
    train, test = edges.where("Source < '4'"), edges.where("Source >= '4'")
    a, b = sample.with_negatives(train, test)
    na, nb = a.where("Class = 0"), b.where("Class = 0")
    pos, neg, neg2 = set(rows(edges, *KEY)), rows(na, *KEY), rows(nb, *KEY)
    assert 0 < len(neg) <= train.count() and len(set(neg)) == len(neg)
    assert not set(neg) & pos and not set(neg2) & pos and not set(neg2) & set(neg)
    assert all(s != t for s, t in neg + neg2) and na.where("Date is not null").count() == 0
    c = rows(sample.negative_corrupt(edges), *KEY)
    assert c and not set(c) & pos
    assert sample.negative_edges(edges.where("false"), 5).count() == 0


def test_evaluate_and_stats(spark):
    d = [(1, 1, 0, 5, "a"), (1, 0, 2, 7, "b"), (0, 0, 0, 1, "a"), (0, 1, 1, 3, "a"), (1, 1, 4, 9, "c"), (None, 1, 0, 0, "z"), (1, None, 0, 0, "z")]
    df = spark.createDataFrame(d, "Class int, Predicted int, Common int, Hub int, Target string")
    assert rows(model.evaluate(df)) == [(2, 1, 1, 1, 0.6667, 0.6667, 0.5833, 0.6, 0.6667)]
    assert rows(model.evaluate(df.where("false")), "tp", "precision", "roc_auc") == [(0, 0.0, 0.0)]
    s = {r.Split: r for r in model.link_stats(df).collect()}
    assert set(s) == {"TP", "FN", "TN", "FP", "POS", "NEG"}
    assert (s["POS"].Common, s["POS"].pct_common_0, s["POS"].NUnique) == (1.6667, 33.3333, 2)
    n = {r.Split: r["count"] for r in model.split_predictions(df).groupBy("Split").count().collect()}
    assert n["POS"] == n["TP"] + n["FP"] and n["NEG"] == n["TN"] + n["FN"]
    p = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "Class int, Probability double")
    assert rows(model.probability_auc(p)) == [(0.625,)]


def test_models(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("int").alias("Class"), (F.col("id") % 2 + F.randn(1) * 0.2).alias("f"), F.lit(None).cast("double").alias("g"))
    for kind in ("rf", "gbt"):
        got = model.fit_predict(df, df, ["f", "g"], model=kind, trees=3, depth=3)
        assert model.evaluate(got).first().accuracy > 0.9
    assert model.cross_validate(df, ["f"], trees=3, depth=3).count() == 2
    with pytest.raises(ValueError, match="unknown"):
        model.fit_predict(df, df, ["f"], model="none")


def test_embedding(spark, edges):
    emb = embed.deepwalk(edges, 5, 1, size=4, iterations=1)
    f = embed.embedding_features(edges.select(*KEY, "Class"), emb, 4)
    assert f.columns == [*KEY, "e0", "e1", "e2", "e3", "Class"] and f.count() == edges.count()


def test_reports(spark, tmp_path):
    q = spark.createDataFrame([(10, "rf", 0.5, 0.5, 0.5, 0.5, 0.5)], report.QUALITY)
    path = str(tmp_path / "q")
    report.write_results(q, path)
    report.write_results(q, path, resume=True)
    assert report.read_results(spark, path).count() == 2
    report.write_results(q, path)
    assert rows(report.read_results(spark, path)) == rows(q)
    (tmp_path / "bare.csv").write_text("10,rf,0.5,0.5,0.5,0.5,0.5\n")
    assert rows(report.read_results(spark, str(tmp_path / "bare.csv"), header=False)) == rows(q)
    m = spark.createDataFrame([(100, 1.5, 2.0), (200, 3.0, 4.0)], "size int, a double, b double")
    report.write_metrics_json(m, "size", str(tmp_path / "j"))
    assert rows(report.read_metrics_json(spark, str(tmp_path / "j"), {"a": "double", "b": "double"})) == [("100", 1.5, 2.0), ("200", 3.0, 4.0)]
    assert rows(report.read_metrics_json(spark, str(tmp_path / "j")), F.col("metrics")["a"]) == [(1.5,), (3.0,)]
    assert rows(report.unpivot(m, "size", ["a", "b"])) == [(100, "a", 1.5), (100, "b", 2.0), (200, "a", 3.0), (200, "b", 4.0)]
    assert rows(report.pivot(report.unpivot(m, "size", ["a", "b"]), "size", "method", "value", ["a", "b"])) == rows(m)
    assert rows(report.transpose(m, "size"), "100", "200") == [(1.5, 3.0), (2.0, 4.0)]
    assert report.union_all([m, m.drop("b")]).where("b is null").count() == 2


def test_streaming(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2008, 7, 1)
    spark.createDataFrame([(t, "a", "b"), (t, "a", "b"), (t, None, "b"), (t + dt.timedelta(days=3), "b", "c")], "Date timestamp, Source string, Target string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("Date timestamp, Source string, Target string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("distinct_e", ingest.distinct_edges(stream), "append"), ("per_w", ingest.edges_per_window(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert rows(spark.table("distinct_e"), *KEY) == [("a", "b"), ("b", "c")]
    assert spark.table("per_w").count() == 2
