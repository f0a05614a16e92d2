import random
from collections import deque

import pytest
from conftest import rows
from pyspark.ml.feature import Word2Vec

from edgeloom.operators import embed, graph, metrics, pairs, walks
from edgeloom.plans import graph_queries

# node: in, out, clustering, average neighbour degree, katz
WANT = {
    "a": (1, 2, 0.5, 2.0, 0.371847), "b": (1, 3, 0.3, 1.0, 0.371847), "c": (2, 1, 0.5, 0.0, 0.409032), "d": (2, 0, 0.5, 0.0, 0.412751),
    "e": (1, 1, 0.0, 1.0, 0.371847), "x": (0, 1, 0.0, 0.0, 0.334663), "y": (1, 0, 0.0, 0.0, 0.368129),
}


def _random_graph(spark, n, m, seed):
    rng = random.Random(seed)
    e = {(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(m)}
    return e, spark.createDataFrame(sorted(e), "Source string, Target string")


def _reach(e, s):
    out, q, paths = {s: 0}, deque([s]), {s: 1}
    while q:
        u = q.popleft()
        for a, b in e:
            if a == u:
                if b not in out:
                    out[b], paths[b] = out[u] + 1, 0
                    q.append(b)
                if out[b] == out[u] + 1:
                    paths[b] += paths[u]
    return out, paths


def test_tiny_vectors(tiny):
    assert rows(graph.degrees(tiny), "node", "in_degree", "out_degree") == [(k, v[0], v[1]) for k, v in WANT.items()]
    for got, at in ((graph.clustering(tiny), 2), (graph.average_neighbor_degree(tiny), 3), (graph.katz(tiny), 4)):
        assert {r[0]: round(r[1], 6) for r in got.collect()} == {k: v[at] for k, v in WANT.items()}
    assert rows(graph.graph_info(tiny)) == [(7, 8, 1.142857, 1.142857)]


def test_tiny_components(tiny):
    assert rows(graph.weak_components(tiny)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("x", "x"), ("y", "x")]
    assert rows(graph.strong_components(tiny)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e"), ("x", "x"), ("y", "y")]
    assert rows(graph.component_stats(graph.weak_components(tiny)), "components", "largest", "smallest") == [(3, 4, 1)]
    assert graph.largest_wcc_edges(tiny).count() == 7


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(spark, seed):
    e, df = _random_graph(spark, 40, 45, seed)
    n = {x for p in e for x in p}
    both = e | {(b, a) for a, b in e}
    for few in (0, 12, graph.FEW):
        assert rows(graph.weak_components(df, few)) == sorted((v, min(_reach(both, v)[0])) for v in n)
    reach = {v: set(_reach(e, v)[0]) for v in n}
    assert rows(graph.strong_components(df)) == sorted((v, min(u for u in reach[v] if v in reach[u])) for v in n)


def test_paths_by_brute_force(spark):
    e, df = _random_graph(spark, 15, 35, 3)
    n = sorted({x for p in e for x in p})
    d = {v: _reach(e, v) for v in n}
    got = graph.bfs_counts(df, graph.nodes(df).toDF("root"))
    assert rows(got) == sorted(((v, u, d[v][0][u], d[v][1][u]) for v in n for u in d[v][0]), key=repr)
    assert rows(graph.reachable_count(df)) == sorted((v, len(d[v][0]) - 1) for v in n)
    close = {}
    bet = dict.fromkeys(n, 0.0)
    for v in n:
        into = [d[u][0][v] for u in n if v in d[u][0]]
        close[v] = (len(into) - 1) ** 2 / sum(into) / (len(n) - 1) if sum(into) else 0.0
        for s in n:
            for t in n:
                if s != t and v not in (s, t) and t in d[s][0] and v in d[s][0] and t in d[v][0] and d[s][0][v] + d[v][0][t] == d[s][0][t]:
                    bet[v] += d[s][1][v] * d[v][1][t] / d[s][1][t]
    assert {r[0]: pytest.approx(r[1]) for r in graph.closeness(df).collect()} == close
    scale = (len(n) - 1) * (len(n) - 2)
    assert {r[0]: pytest.approx(r[1] * scale) for r in graph.betweenness(df, None).collect()} == bet
    assert graph.betweenness(df, 3).count() == len(n)


def test_katz_raises_when_it_diverges(spark):
    e = [(str(a), str(b)) for a in range(12) for b in range(12)]
    with pytest.raises(RuntimeError):
        graph.katz(spark.createDataFrame(e, "Source string, Target string"), max_iter=6)


def test_propflow(spark, tiny):
    got = {r[0]: r[1] for r in graph.propflow(tiny, graph.nodes(graph.digraph(tiny)).toDF("root"), 1).collect()}
    # a: itself 1, b and c a half each
    assert got["a"] == pytest.approx(2 / 3) and got["d"] == 1.0 and got["e"] == 2.0


def test_pair_features(spark, tiny):
    want = {
        ("a", "b"): (1, 0.25, 0.910239, 12, 0.167, 5), ("a", "c"): (0, 0, 0, 9, 0.2, 3), ("c", "a"): (0, 0, 0, 9, 0.2, 3), ("a", "d"): (0, 0, 0, 6, 0.25, 2),
        ("x", "y"): (0, 0, 0, 1, 1.0, 1), ("d", "y"): (0, 0, 0, 2, 0.5, 0), ("e", "e"): (1, 1.0, 1.442695, 4, 0.333, 2), ("q", "a"): (0, 0, 0, 0, 0.5, 2),
    }
    p = spark.createDataFrame([(*k, "clash") for k in want], "Source string, Target string, common2 string")
    got = pairs.pair_features(tiny, p).collect()
    assert {(r.Source, r.Target): (r.common, round(r.jaccard, 6), round(r.adamic_adar, 6), r.pref_attach, r.friends, r.volume) for r in got} == want
    h = pairs.heuristics(tiny, p.selectExpr("Source", "Target", "1 Class"))
    assert h.columns == ["Source", "Target", *pairs.HEURISTICS, "Class"]
    assert len(pairs.heuristics(tiny, p.selectExpr("Source", "Target", "1 Class"), with_katz=False).columns) == 13
    with pytest.raises(ValueError, match="unknown"):
        pairs.similarity(tiny, p, "none")


def test_katz_pairs_and_hadamard(spark, tiny):
    p = spark.createDataFrame([("a", "b"), ("a", "d"), ("d", "a"), (None, "a")], "Source string, Target string")
    # a->d: over b and c
    assert rows(pairs.katz_pairs(tiny, p, 0.5)) == [("a", "b", 0.5), ("a", "d", 0.5), ("d", "a", 0.0)]
    emb = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -1.0])], "node string, emb array<double>")
    assert rows(pairs.hadamard(p, emb)) == [("a", "b", [3.0, -2.0])]


def test_empty_graph(spark):
    e = spark.createDataFrame([], "Source string, Target string")
    for f in (graph.degrees, graph.weak_components, graph.strong_components, graph.clustering, graph.average_neighbor_degree, graph.reachable_count, graph.closeness, graph.betweenness):
        assert f(e).count() == 0
    assert rows(graph.graph_info(e), "nodes", "edges") == [(0, 0)]
    assert pairs.pair_features(e, spark.createDataFrame([("a", "b")], "Source string, Target string")).first().common == 0


def test_metrics_row(tiny):
    r = metrics.graph_metrics(tiny, centralities=True).first()
    assert (r.nodes, r.edges, r.scc_count, r.wcc_count, r.max_out_degree) == (7, 8, 6, 3, 3.0)


def test_walks(spark, tiny):
    e = {tuple(r) for r in graph.digraph(tiny).collect()}
    out = {a for a, _ in e}
    for w in (walks.uniform_walks(tiny, 12, 3), walks.node2vec_walks(tiny, 8, 2, 0.25, 4.0)):
        got = w.collect()
        assert len({r.walk_id for r in got}) == len(got) and len(got) % 7 == 0
        assert all(p in e for r in got for p in zip(r.walk, r.walk[1:], strict=False))
    full = walks.uniform_walks(tiny, 12, 3).collect()
    assert all(len(r.walk) == 12 or r.walk[-1] not in out for r in full)
    sa = walks.self_avoiding_walks(tiny, 5, 2).collect()
    assert all(len(set(r.walk)) == len(r.walk) for r in sa)
    assert rows(walks.uniform_walks(tiny, 12, 3)) == rows(walks.uniform_walks(tiny, 12, 3))
    assert rows(walks.length_histogram(spark.createDataFrame([(["a"],), (["a", "b"],)], "walk array<string>"))) == [(1, 1), (2, 1)]


def test_node2vec_weights(spark):
    # from b the walk may return to a (1/p), go to c, which a knows (1), or to d (1/q)
    e = [("s", "a")] + [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("b", "d")]
    df = spark.createDataFrame(e, "Source string, Target string")
    w = walks.node2vec_walks(df, 3, 3000, 0.5, 4.0).collect()
    third = [r.walk[2] for r in w if r.walk[:2] == ["a", "b"]]
    share = [third.count(x) / len(third) for x in "acd"]
    assert share == pytest.approx([2 / 3.25, 1 / 3.25, 0.25 / 3.25], abs=0.05)


def test_shortest_path_count_has_every_distance(spark, tmp_path):
    # two ways from 0 to 2, then a chain
    e = {(0, 1), (0, 9), (9, 2)} | {(i, i + 1) for i in range(1, 8)}
    spark.createDataFrame(sorted(e), "Source int, Target int").write.parquet(str(tmp_path / "hepph_edges.parquet"))
    text = {(str(a), str(b)) for a, b in e}
    d = {v: _reach(text, v) for v in {x for p in text for x in p}}
    got = graph_queries.shortest_path_count(spark, str(tmp_path))
    assert rows(got) == sorted(((v, u, d[v][0][u], d[v][1][u]) for v in d for u in d[v][0]), key=repr)
    assert got.agg({"dist": "max"}).first()[0] == 8


def test_embedding_queries_use_the_full_setting(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1)], "Source int, Target int").write.parquet(str(tmp_path / "hepph_edges.parquet"))
    seen = []
    monkeypatch.setattr(embed, "Word2Vec", lambda **kw: seen.append(kw) or Word2Vec(**kw))
    monkeypatch.setattr(embed.walk_ops, "uniform_walks", lambda e, length, num, seed: seen.append((length, num)) or walks.self_avoiding_walks(e, 4, 1, seed=seed))
    emb = graph_queries.embed_deepwalk(spark, str(tmp_path)).collect()
    assert seen[0] == (80, 10) and (seen[1]["vectorSize"], seen[1]["maxIter"]) == (128, 4)
    assert len(emb) == 3 and all(len(r.emb) == 128 for r in emb)


def test_reach_estimates(spark, tiny):
    """Small sets are exact, large ones within the stated error."""
    e, df = _random_graph(spark, 300, 700, 5)
    reach = {v: _reach(e, v)[0] for v in {x for p in e for x in p}}
    got = {r.node: r for r in graph.reach_estimates(df).collect()}
    assert set(got) == set(reach)
    for v, d in reach.items():
        assert abs(got[v].reached - len(d)) <= max(1, 5 * 1.04 / 64 * len(d))
        assert abs(got[v].distance_sum - sum(d.values())) <= max(2, 0.2 * sum(d.values()))
    close = lambda df: {r.node: round(r.closeness, 6) for r in df.collect()}
    assert close(graph.closeness_estimates(tiny)) == close(graph.closeness(tiny))
    assert graph.reach_estimates(tiny.where("false")).count() == 0
    with pytest.raises(RuntimeError):
        graph.reach_estimates(df, max_rounds=1)
