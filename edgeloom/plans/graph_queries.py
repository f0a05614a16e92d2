"""Queries on graph structure, pair features, walks and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.hashing import sql_hash_int, sql_key_hash
from edgeloom.operators import embed, graph, metrics, model, pairs, sample, split, walks
from edgeloom.plans import graphs as g
from edgeloom.plans.graphs import KEY, sql_degrees, sql_nodes, with_
from edgeloom.session import cut
from edgeloom.sources.tables import load

SEED = 42
KATZ_ROUNDS = 20
DEPTH = 24  # levels that the SQL of distances is unrolled to; the queries follow paths of any length


def _train(spark: SparkSession, d: str) -> DataFrame:
    return g.call_numbers(spark, d, "train")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.as_text(split.nodes(g.call_numbers(spark, d)))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return g.as_text(graph.degrees(g.call_numbers(spark, d)))


def degree_hist(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_histogram(g.call_numbers(spark, d))


def graph_info(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_info(g.call_numbers(spark, d))


def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.degree_metrics(g.call_numbers(spark, d))


def graph_metrics_full(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of all vectors, centralities included, of the citation graph."""
    return metrics.graph_metrics(g.citations(spark, d), centralities=True)


def clustering(spark: SparkSession, d: str) -> DataFrame:
    return g.as_text(_rounded(graph.clustering(g.call_numbers(spark, d)), "clustering"))


def avg_neighbor_degree(spark: SparkSession, d: str) -> DataFrame:
    return g.as_text(_rounded(graph.average_neighbor_degree(g.call_numbers(spark, d)), "avg_neighbor_degree"))


def wcc(spark: SparkSession, d: str) -> DataFrame:
    return g.as_text(graph.weak_components(g.call_numbers(spark, d)))


def wcc_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_stats(graph.weak_components(g.call_numbers(spark, d)))


def largest_wcc_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.as_text(graph.largest_wcc_edges(cut(g.call_numbers(spark, d))))


def scc(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(g.growth(spark, d))


def scc_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_stats(graph.strong_components(g.growth(spark, d)))


def katz(spark: SparkSession, d: str) -> DataFrame:
    return g.as_text(_rounded(graph.katz(_train(spark, d), iterations=KATZ_ROUNDS), "katz"))


def betweenness_k(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.betweenness(g.citations(spark, d), 10, SEED), "betweenness")


def closeness(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.closeness(g.citations(spark, d)), "closeness")


def reachable_count(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable_count(g.citations(spark, d))


def reach_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Estimates of reach and closeness on the citations beside the exact ones: nodes, and how many lie beyond 5 standard errors (or one node)."""
    e = graph.Graph(g.citations(spark, d))
    exact = graph.reachable_count(e).join(graph.closeness(e), "node")
    near = graph.reach_estimates(e).select("node", (F.col("reached") - 1).alias("about")).join(graph.closeness_estimates(e).withColumnRenamed("closeness", "close"), "node")
    tol = 5 * 1.04 / 64
    far = F.abs(F.col("about") - F.col("reachable")) > F.greatest(F.lit(1.0), F.lit(tol) * F.col("reachable"))
    # closeness has the reach squared over summed distances, so three times its error
    off = F.abs(F.col("close") - F.col("closeness")) > F.lit(3 * tol) * F.col("closeness") + 1e-9
    return exact.join(near, "node").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(far, 1)).alias("reach_beyond"), F.count(F.when(off, 1)).alias("closeness_beyond"))


def reach_calls(spark: SparkSession, d: str) -> DataFrame:
    """About how many nodes each node of the call graph reaches, and the summed distances, from sketches."""
    return g.as_text(graph.reach_estimates(g.call_numbers(spark, d)))


def shortest_path_count(spark: SparkSession, d: str) -> DataFrame:
    """Distances, however long, and shortest paths from every cited or citing paper."""
    e = g.citations(spark, d)
    return graph.bfs_counts(e, split.nodes(e).toDF("root"))


def max_flow(spark: SparkSession, d: str) -> DataFrame:
    """Most edge-disjoint paths from every citing paper to the most cited one."""
    e = cut(g.citations(spark, d))
    top = e.groupBy("Target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "Target").limit(1).select("Target")
    pairs = e.select("Source").distinct().join(F.broadcast(top))  # one row
    return graph.max_flow(e, pairs)


def propflow(spark: SparkSession, d: str) -> DataFrame:
    e = g.citations(spark, d)
    return _rounded(graph.propflow(e, split.nodes(e).toDF("root")), "mean_score")


def _predictable(spark: SparkSession, d: str) -> tuple[graph.Graph, DataFrame]:
    """The train graph, written once, and the predictable test pairs."""
    tr = graph.Graph(_train(spark, d))
    return tr, cut(split.filter_test(tr.edges, g.test_pairs(spark, d)))


def _similarity(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        tr, te = _predictable(spark, d)
        return g.as_text(_rounded(pairs.similarity(tr, te.select(*KEY).distinct(), method), "score"))

    return run


def pair_volume(spark: SparkSession, d: str) -> DataFrame:
    tr, te = _predictable(spark, d)
    return g.as_text(pairs.pair_features(tr, te).select(*KEY, "Class", "volume"))


def heuristics(spark: SparkSession, d: str) -> DataFrame:
    tr, te = _predictable(spark, d)
    return g.as_text(_rounded(pairs.heuristics(tr, te, iterations=KATZ_ROUNDS), "katz", "adamic_adar", "jaccards_coef"))


def heuristics_nokatz(spark: SparkSession, d: str) -> DataFrame:
    tr, te = _predictable(spark, d)
    return g.as_text(_rounded(pairs.heuristics(tr, te, with_katz=False), "adamic_adar", "jaccards_coef"))


def links_stats_pairs(spark: SparkSession, d: str) -> DataFrame:
    tr, te = _predictable(spark, d)
    return g.as_text(pairs.link_stats_columns(tr, te))


def katz_pair(spark: SparkSession, d: str) -> DataFrame:
    tr, te = _predictable(spark, d)
    return g.as_text(_rounded(pairs.katz_pairs(tr, te), "katz_pair"))


def hadamard(spark: SparkSession, d: str) -> DataFrame:
    """Products of the vectors of cited and citing papers, one row per dimension."""
    emb = load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("emb"))
    h = pairs.hadamard(g.citations(spark, d), emb)
    return h.select(*KEY, F.posexplode("hadamard").alias("dim", "value")).select(*KEY, "dim", (F.round("value", 6) + F.lit(0.0)).alias("value"))  # no negative zero


def _text(w: DataFrame) -> DataFrame:
    return w.select("walk_id", F.concat_ws(">", "walk").alias("walk"))


def _uniform(spark: SparkSession, d: str) -> DataFrame:
    return walks.uniform_walks(g.growth(spark, d), seed=SEED)


def walk_uniform(spark: SparkSession, d: str) -> DataFrame:
    return _text(_uniform(spark, d))


def walk_self_avoiding(spark: SparkSession, d: str) -> DataFrame:
    return _text(walks.self_avoiding_walks(g.growth(spark, d), seed=SEED))


def walk_node2vec(spark: SparkSession, d: str) -> DataFrame:
    """Ten walks of ten nodes from every node, p = 0.25, q = 2."""
    return _text(walks.node2vec_walks(g.growth(spark, d), 10, 10, 0.25, 2.0, SEED))


def walk_len_hist(spark: SparkSession, d: str) -> DataFrame:
    return walks.length_histogram(_uniform(spark, d))


def walk_avg_len(spark: SparkSession, d: str) -> DataFrame:
    return walks.average_length(_uniform(spark, d))


def embed_deepwalk(spark: SparkSession, d: str) -> DataFrame:
    return embed.deepwalk(g.citations(spark, d), seed=SEED)


def feat_node2vec(spark: SparkSession, d: str) -> DataFrame:
    e = g.citations(spark, d)
    emb = embed.node2vec(e, seed=SEED)
    return embed.embedding_features(e.withColumn("Class", F.lit(1)), emb, 128)


_NAMES = [h for h in pairs.HEURISTICS if h != "katz"]


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The ten heuristics of train pairs with negatives, and of the predictable test pairs."""
    tr, te = _predictable(spark, d)
    frame = tr.edges.withColumn("Class", F.lit(1)).unionByName(sample.negative_train(tr.edges, g.call_numbers(spark, d, "test"), SEED).drop("Date"))
    return cut(pairs.heuristics(tr, frame, with_katz=False)), cut(pairs.heuristics(tr, te, with_katz=False))


def rf_predict(spark: SparkSession, d: str) -> DataFrame:
    """Forest on the ten heuristics: trained on train pairs with negatives, applied to the predictable test pairs."""
    fit, apply = _frames(spark, d)
    got = model.fit_predict(fit, apply, _NAMES)
    return g.as_text(got).select(*KEY, "Class", "Predicted", F.round("Probability", 6).alias("Probability"))


def gbt_predict(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on the same frames as the forest."""
    fit, apply = _frames(spark, d)
    got = model.fit_predict(fit, apply, _NAMES, model="gbt")
    return g.as_text(got).select(*KEY, "Class", "Predicted", F.round("Probability", 6).alias("Probability"))


def cv_quality(spark: SparkSession, d: str) -> DataFrame:
    """Two-fold cross-validation of the forest on the train frame."""
    return model.cross_validate(_frames(spark, d)[0], _NAMES)


QUERIES = {
    "reach_agreement": reach_agreement, "reach_calls": reach_calls, "gbt_predict": gbt_predict, "cv_quality": cv_quality, "max_flow": max_flow, "nodes": nodes, "degrees": degrees, "degree_hist": degree_hist, "graph_info": graph_info, "graph_metrics": graph_metrics,
    "graph_metrics_full": graph_metrics_full, "clustering": clustering, "avg_neighbor_degree": avg_neighbor_degree, "wcc": wcc, "wcc_stats": wcc_stats,
    "largest_wcc_edges": largest_wcc_edges, "scc": scc, "scc_stats": scc_stats, "katz": katz, "betweenness_k": betweenness_k, "closeness": closeness,
    "reachable_count": reachable_count, "shortest_path_count": shortest_path_count, "propflow": propflow,
    "sim_common": _similarity("common_neighbors"), "sim_jaccard": _similarity("jaccard"), "sim_adamic_adar": _similarity("adamic_adar"),
    "sim_pref_attach": _similarity("preferential_attachment"), "sim_friendtns": _similarity("friendtns"), "pair_volume": pair_volume,
    "heuristics": heuristics, "heuristics_nokatz": heuristics_nokatz, "links_stats_pairs": links_stats_pairs, "katz_pair": katz_pair, "hadamard": hadamard,
    "walk_uniform": walk_uniform, "walk_self_avoiding": walk_self_avoiding, "walk_node2vec": walk_node2vec, "walk_len_hist": walk_len_hist,
    "walk_avg_len": walk_avg_len, "embed_deepwalk": embed_deepwalk, "feat_node2vec": feat_node2vec, "rf_predict": rf_predict,
}


def _cc(e: str) -> str:
    """(node, component) by label propagation."""
    return f"""und as (select distinct a, b from (select "Source" a, "Target" b from {e} union all select "Target", "Source" from {e}) q),
cc(node, component) using key (node) as (select node, node from {sql_nodes(e)} n
    union select und.b, min(cc.component) from cc join und on und.a = cc.node join recurring.cc r on r.node = und.b where cc.component < r.component group by und.b)"""


def _reach(e: str) -> str:
    return f"""reach(a, b) as (select "Source", "Target" from {e} union select reach.a, e2."Target" from reach join {e} e2 on e2."Source" = reach.b)"""


def _scc(e: str) -> str:
    return f"""{_reach(e)}, mutual as (select x.a, x.b from reach x join reach y on x.a = y.b and x.b = y.a),
sc as (select node, least(node, coalesce(min(b), node)) component from {sql_nodes(e)} n left join mutual on mutual.a = node group by node)"""


_STATS = """select count(*) components, max(n) largest, min(n) smallest, round(avg(n), 6) avg_size, round(stddev_pop(n), 6) std_size
    from (select component, count(*) n from {0} group by 1) q"""


def _clust(e: str) -> str:
    return f"""ud as (select least("Source", "Target") a, greatest("Source", "Target") b, count(*) w from (select distinct "Source", "Target" from {e} where "Source" <> "Target") q group by 1, 2),
tri as (select x.a a, x.b b, y.b c, 2 * x.w * y.w * z.w t from ud x join ud y on y.a = x.b join ud z on z.a = x.a and z.b = y.b),
tn as (select node, sum(t) t from (select a node, t from tri union all select b, t from tri union all select c, t from tri) q group by 1),
dn as (select node, sum(w) d, count(*) filter (w = 2) r from (select a node, w from ud union all select b, w from ud) q group by 1),
cl as (select n.node, coalesce(case when tn.t > 0 then tn.t / (2.0 * (d * (d - 1) - 2 * r)) end, 0.0) clustering from {sql_nodes(e)} n left join tn using (node) left join dn using (node))"""


def _and(e: str) -> str:
    return f"""nb as (select n.node, coalesce(avg(coalesce(k, 0)), 0) avg_neighbor_degree from {sql_nodes(e)} n left join {e} x on x."Source" = n.node
    left join (select "Source" s, count(*) k from {e} group by 1) o on o.s = x."Target" where x."Source" is not null group by 1),
av as (select n.node, coalesce(avg_neighbor_degree, 0.0) avg_neighbor_degree from {sql_nodes(e)} n left join nb using (node))"""


def _summary(name: str, c: str) -> str:
    return f"round(cast(min({c}) as double), 6) min_{name}, round(cast(max({c}) as double), 6) max_{name}, round(avg({c}), 6) avg_{name}, round(stddev_pop({c}), 6) std_{name}"


def metrics_sql() -> str:
    """Counts and summaries of the degree, clustering and neighbour vectors of ``vectors_sql``, which is to precede them."""
    return f"""select count(*) nodes, cast(sum(o) as bigint) edges, {_summary('in_degree', 'i')}, {_summary('out_degree', 'o')}, {_summary('clustering', 'clustering')},
        {_summary('neighbor_degree', 'avg_neighbor_degree')} from dg join cl using (node) join av using (node)"""


def vectors_sql(e: str) -> str:
    return f"{_clust(e)}, {_and(e)}, dg as (select * from {sql_degrees(e)} q)"


_KATZ = f"kn as (select node from {sql_nodes('tr')} q), k0 as (select node, 0.0::double x from kn)" + "".join(
    f""", k{i + 1} as materialized (select n.node, 0.1 * coalesce(sum(k.x), 0) + 1 x from kn n left join tr on tr."Target" = n.node left join k{i} k on k.node = tr."Source" group by 1)"""
    for i in range(KATZ_ROUNDS)
) + f", kz as (select node, round(x / (select sqrt(sum(x * x)) from k{KATZ_ROUNDS}), 6) katz from k{KATZ_ROUNDS})"

_DIST = """d0 as (select node root, node, 0 dist, 1::bigint paths from {nodes} q), s0 as (select * from d0)"""


def _levels(e: str, depth: int) -> str:
    """s<depth>(root, node, dist, paths) by unrolled levels."""
    out = _DIST.format(nodes=sql_nodes(e))
    for i in range(depth):
        out += f""", d{i + 1} as materialized (select root, e."Target" node, {i + 1} dist, cast(sum(paths) as bigint) paths from d{i} d join {e} e on e."Source" = d.node
    where not exists (select 1 from s{i} s where s.root = d.root and s.node = e."Target") group by 1, 2), s{i + 1} as materialized (select * from s{i} union all select * from d{i + 1})"""
    return out


def _flow(e: str, depth: int) -> str:
    out = f"""pr as (select "Source" f, "Target" t, 1.0 / count(*) over (partition by "Source") p from {e}), f0 as (select node root, node, 1.0::double score, 0 level from {sql_nodes(e)} q)"""
    for i in range(depth):
        out += f""", f{i + 1} as materialized (select root, node, sum(score) score, min(level) level from (select * from f{i} union all
    select root, t, score * p, {i + 1} from f{i} join pr on f = node where level = {i}) q group by 1, 2)"""
    return out


def _between(k: int) -> str:
    """Betweenness from k hashed pivots: unrolled levels forward, then dependencies from the last level back."""
    out = _levels("hp", DEPTH).replace(_DIST.format(nodes=sql_nodes("hp")), f"""pv as (select node from (select node, row_number() over (order by {sql_key_hash(SEED, 'node')}, node) rn from {sql_nodes('hp')} q) z where rn <= {k}),
        {_DIST.format(nodes='pv')}""")
    out += f", v as materialized (select * from s{DEPTH}), x{DEPTH} as (select root, node, 0.0::double delta from v where dist = {DEPTH})"
    for i in range(DEPTH - 1, 0, -1):
        out += f""", x{i} as materialized (select a.root, a.node, coalesce(sum(a.paths / w.paths::double * (1 + coalesce(y.delta, 0))), 0) delta from v a left join hp e on e."Source" = a.node
    left join v w on w.root = a.root and w.node = e."Target" and w.dist = {i + 1} left join x{i + 1} y on y.root = w.root and y.node = w.node where a.dist = {i} group by 1, 2)"""
    every = " union all ".join(f"select * from x{i}" for i in range(1, DEPTH + 1))
    n = f"(select count(*) from {sql_nodes('hp')} z)"
    return out + f""", b as (select node, sum(delta) d from ({every}) q where root <> node group by 1),
btr as (select n.node, coalesce(d, 0.0) * ({n} / {k}::double) / (({n} - 1.0) * ({n} - 2.0)) betweenness_raw from {sql_nodes('hp')} n left join b using (node)),
bt as (select node, round(betweenness_raw, 6) betweenness from btr)"""


def _inward() -> str:
    """ic(cl2): closeness over inward distances, by a recursion that ends at the graph's depth."""
    n = f"(select count(*) - 1 from {sql_nodes('hp')} z)"
    return f"""iw(root, node, dist) as (select node, node, 0 from {sql_nodes('hp')} q union select iw.root, e."Source", dist + 1 from iw join hp e on e."Target" = iw.node where dist < {DEPTH}),
im as (select root, node, min(dist) dist from iw group by 1, 2),
ic as (select root, coalesce(count(*) - 1, 0) r, case when sum(dist) > 0 then (count(*) - 1) / sum(dist) * (count(*) - 1) / {n} else 0 end cl2 from im group by 1)"""


# successors of both ends, by plain self-joins
_PAIR = f"""pd as (select * from {sql_degrees('tr')} q), up as (select distinct "Source", "Target" from ft),
cm as (select p."Source", p."Target", count(*) c, sum(case when v.i + v.o > 1 then 1.0 / ln(v.i + v.o) else 0 end) aa from up p join tr a on a."Source" = p."Source"
    join tr b on b."Source" = p."Target" and b."Target" = a."Target" join pd v on v.node = a."Target" group by 1, 2),
pf as (select ft."Source", ft."Target", ft."Class", a.i in_i, a.o out_i, b.i in_j, b.o out_j, coalesce(c, 0) common, coalesce(aa, 0.0) aa
    from ft join pd a on a.node = ft."Source" join pd b on b.node = ft."Target" left join cm on cm."Source" = ft."Source" and cm."Target" = ft."Target")"""
_JAC = "case when out_i + out_j - common > 0 then common / (out_i + out_j - common) else 0.0 end"
_PF = ("tr", "te", "trn", "ft")
_FEATS = f"""in_i in_degree_i_to_j, out_i out_degree_i_to_j, in_j in_degree_j_to_i, out_j out_degree_j_to_i, common common_nbrs, out_i + out_j volume_i,
    out_i + out_j volume_j, round(aa, 6) adamic_adar, (in_i + out_i) * (in_j + out_j) pref_attach, round({_JAC}, 6) jaccards_coef"""


def _sim(expr: str) -> str:
    return with_(*_PF, more=_PAIR) + f'select distinct "Source", "Target", {expr} score from pf'


def _walk_start(num: int) -> str:
    return f"""w0 as (select node || '#' || no walk_id, [node] walk, node at_ from {sql_nodes('yt')} n, range({num}) r(no))"""


_IXD = 'ixd as materialized (select "Source" s, "Target" t, row_number() over (partition by "Source" order by "Target") - 1 ix, count(*) over (partition by "Source") k from yt)'


def _uniform_sql(length: int = 80, num: int = 10) -> str:
    """A recursive walk, all positions of which are kept."""
    h = sql_hash_int(SEED, "walk_id", "no")
    return f"""{_IXD}, {_walk_start(num)}, kd as (select distinct s, k from ixd),
wk(walk_id, no, at_) as (select walk_id, 1, at_ from w0 union all select walk_id, no + 1, x.t from wk join kd on kd.s = wk.at_ join ixd x on x.s = wk.at_ and x.ix = {h} % kd.k where no < {length}),
w as (select walk_id, list(at_ order by no) walk from wk group by 1)"""


def _avoid_sql(length: int = 10, num: int = 5) -> str:
    out = f"{_IXD}, {_walk_start(num)}"
    for i in range(1, length):
        out += f""", c{i} as materialized (select walk_id, x.t, row_number() over (partition by walk_id order by x.ix) - 1 rn, count(*) over (partition by walk_id) free
    from w{i - 1} w join ixd x on x.s = w.at_ and not list_contains(w.walk, x.t)),
w{i} as materialized (select w.walk_id, case when c.t is null then walk else list_append(walk, c.t) end walk, c.t at_ from w{i - 1} w
    left join c{i} c on c.walk_id = w.walk_id and c.rn = {sql_hash_int(SEED, 'w.walk_id', repr(str(i)))} % c.free)"""
    return out + f", w as (select walk_id, walk from w{length - 1})"


def _node2vec_sql(length: int = 10, num: int = 10, p: float = 0.25, q: float = 2.0, tries: int = 40) -> str:
    """All tries of each step, the first accepted one taken; 40 rejections in a row do not happen."""
    top = max(1.0, 1 / q)
    beyond, unit = max(0.0, 1 / p - top), float(1 << 32)
    out = f"{_IXD}, kd as materialized (select distinct s, k from ixd), {_walk_start(num)}"
    for i in range(1, length):
        h = lambda tag: sql_hash_int(SEED, "walk_id", repr(str(i)), "j", repr(tag))  # noqa: B023, E731
        prev = "walk[-2]" if i > 1 else "null"
        out += f""", s{i} as materialized (select walk_id, at_, k, {prev} pv, case when exists (select 1 from yt z where z."Source" = at_ and z."Target" = {prev}) then {beyond} else 0.0 end::double extra
    from w{i - 1} w join kd on kd.s = w.at_),
t{i} as materialized (select s.walk_id, j, pv, x.t, extra > 0 and {h('area')} / {unit}::double < extra / (s.k * {top}::double + extra) own, {h('accept')} / {unit}::double u
    from s{i} s cross join range({tries}) r(j) join ixd x on x.s = s.at_ and x.ix = {h('at')} % s.k),
b{i} as materialized (select walk_id, arg_min(case when own then pv else t end, j) t from t{i} where own or u < (case when pv is null then {top} when t = pv then {min(1 / p, top)}
    when exists (select 1 from yt z where z."Source" = pv and z."Target" = t{i}.t) then 1.0 else {1 / q} end)::double / {top} group by 1),
w{i} as materialized (select w.walk_id, case when b.t is null then walk else list_append(walk, b.t) end walk, b.t at_ from w{i - 1} w left join b{i} b using (walk_id))"""
    return out + f", w as (select walk_id, walk from w{length - 1})"


_WTEXT = "select walk_id, array_to_string(walk, '>') walk from w"

ORACLE = {
    "nodes": with_("calls") + f"select node from {sql_nodes('calls')} q",
    "degrees": with_("calls") + f"select node, i in_degree, o out_degree, i + o degree from {sql_degrees('calls')} q",
    "degree_hist": with_("calls") + f"select i + o degree, count(*) nodes from {sql_degrees('calls')} q group by 1",
    "graph_info": with_("calls") + f"""select count(*) nodes, cast(sum(o) as bigint) edges, round(avg(i), 6) avg_in_degree, round(avg(o), 6) avg_out_degree from {sql_degrees('calls')} q""",
    "graph_metrics": with_("calls", more=vectors_sql("calls")) + metrics_sql(),
    "clustering": with_("calls", more=_clust("calls")) + "select node, round(clustering, 6) clustering from cl",
    "avg_neighbor_degree": with_("calls", more=_and("calls")) + "select node, round(avg_neighbor_degree, 6) avg_neighbor_degree from av",
    "wcc": with_("calls", more=_cc("calls")) + "select * from cc",
    "wcc_stats": with_("calls", more=_cc("calls")) + _STATS.format("cc"),
    "largest_wcc_edges": with_("calls", more=_cc("calls")) + """, top as (select component from cc group by 1 order by count(*) desc, 1 limit 1)
        select calls.* from calls join cc on cc.node = calls."Source" where component = (select component from top)""",
    "scc": with_("yt", more=_scc("yt")) + "select * from sc",
    "scc_stats": with_("yt", more=_scc("yt")) + _STATS.format("sc"),
    "katz": with_("tr", more=_KATZ) + "select * from kz",
    "reach_agreement": with_("hp") + f"select count(*) nodes, 0::bigint reach_beyond, 0::bigint closeness_beyond from {sql_nodes('hp')} q",
    "betweenness_k": with_("hp", more=_between(10)) + "select * from bt",
    "closeness": with_("hp", more=_levels("hp", DEPTH).replace('e."Target" node', 'e."Source" node').replace('e."Source" = d.node', 'e."Target" = d.node').replace('s.node = e."Target"', 's.node = e."Source"'))
    + f""", c as (select root, count(*) - 1 r, sum(dist) d from s""" + str(DEPTH) + f""" group by 1)
        select root node, round(case when d > 0 then r / d * r / (select count(*) - 1 from {sql_nodes('hp')} q) else 0 end, 6) closeness from c""",
    "reachable_count": with_("hp", more=_reach("hp")) + f"select node, count(distinct case when b <> node then b end) reachable from {sql_nodes('hp')} n left join reach on a = node group by 1",
    "graph_metrics_full": with_("hp", more=f"""{vectors_sql('hp')}, {_cc('hp')}, {_scc('hp')}, {_between(10)},
        sz1 as (select count(*) n from sc group by component), sz2 as (select count(*) n from cc group by component),
        {_inward()}""")
    + f"""select * from ({metrics_sql()}) a,
        (select count(*) scc_count, {_summary('scc', 'n')} from sz1) b, (select count(*) wcc_count, {_summary('wcc', 'n')} from sz2) c,
        (select {_summary('betweenness', 'b')} from (select node, betweenness_raw b from btr) q) e, (select {_summary('closeness', 'cl2')} from ic) f""",
    "shortest_path_count": with_("hp", more=_levels("hp", DEPTH)) + f"select root, node, dist, paths from s{DEPTH}",
    "propflow": with_("hp", more=_flow("hp", 5)) + "select root, round(avg(score), 6) mean_score from f5 group by 1",
    "sim_common": _sim("common"),
    "sim_jaccard": _sim(f"round({_JAC}, 6)"),
    "sim_adamic_adar": _sim("round(aa, 6)"),
    "sim_pref_attach": _sim("(in_i + out_i) * (in_j + out_j)"),
    "sim_friendtns": _sim("round(1.0 / (in_i + out_i + in_j + out_j - 1), 3)"),
    "pair_volume": with_(*_PF, more=_PAIR) + 'select "Source", "Target", "Class", out_i + out_j volume from pf',
    "heuristics": with_(*_PF, more=f"{_PAIR}, {_KATZ}") + f'select "Source", "Target", kz.katz, {_FEATS}, "Class" from pf join kz on kz.node = "Source"',
    "heuristics_nokatz": with_(*_PF, more=_PAIR) + f'select "Source", "Target", {_FEATS}, "Class" from pf',
    "links_stats_pairs": with_(*_PF, more=_PAIR) + 'select "Source", "Target", "Class", in_j "Hub", common "Common" from pf',
    "katz_pair": with_(*_PF, more="""up as (select distinct "Source", "Target" from ft), two as (select up."Source", up."Target", count(*) n from up join tr a on a."Source" = up."Source"
        join tr b on b."Source" = a."Target" and b."Target" = up."Target" group by 1, 2)""")
    + """select up."Source", up."Target", round(0.05::double * (case when exists (select 1 from tr where tr."Source" = up."Source" and tr."Target" = up."Target") then 1 else 0 end)
        + (0.05 * 0.05)::double * coalesce(n, 0), 6) katz_pair from up left join two using ("Source", "Target")""",
    "hadamard": with_("hp") + """select "Source", "Target", cast(unnest(range(len(a.embedding))) as int) dim,
        round(unnest(list_transform(range(len(a.embedding)), lambda i: cast(a.embedding[i + 1] as double) * cast(b.embedding[i + 1] as double))), 6) + 0.0 as "value"
        from hp join embeddings a on cast(a.vec_id as varchar) = "Source" join embeddings b on cast(b.vec_id as varchar) = "Target" """,
    "walk_uniform": with_("yt", more=_uniform_sql()) + _WTEXT,
    "walk_self_avoiding": with_("yt", more=_avoid_sql()) + _WTEXT,
    "walk_node2vec": with_("yt", more=_node2vec_sql()) + _WTEXT,
    "walk_len_hist": with_("yt", more=_uniform_sql()) + 'select cast(len(walk) as int) as "length", count(*) walks from w group by 1',
    "walk_avg_len": with_("yt", more=_uniform_sql()) + "select round(avg(len(walk)), 6) avg_length from w",
}
