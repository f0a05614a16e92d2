"""Features of node pairs: neighbourhood similarities, the heuristic feature set, link statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import graph
from edgeloom.operators.split import KEY
from edgeloom.session import written


def common_successors(edges: graph.Edges, pairs: DataFrame) -> DataFrame:
    """(Source, Target, common, adamic_adar) of the distinct pairs that share a successor.

    Each pair expands its endpoint with fewer successors and looks the other endpoint's edge up by an equality join,
    so the work per pair follows the smaller neighbourhood and a hub is never expanded for a leaf's sake.
    adamic_adar sums 1 / ln(total degree) over common successors, leaving out those of degree 1.
    """
    e = graph.digraph(edges)
    deg = graph.degrees(edges)
    inv = F.when(F.col("degree") > 1, F.lit(1.0) / F.log("degree")).otherwise(F.lit(0.0))
    weight = deg.select(F.col("node").alias("v"), inv.alias("aa"))
    out = deg.where("out_degree > 0").select("node", "out_degree")
    p = pairs.select(*KEY).where("Source is not null and Target is not null").distinct()
    p = p.join(out.toDF("Source", "oi"), "Source").join(out.toDF("Target", "oj"), "Target")
    first = F.col("oi") <= F.col("oj")
    p = p.select(*KEY, F.when(first, F.col("Source")).otherwise(F.col("Target")).alias("small"), F.when(first, F.col("Target")).otherwise(F.col("Source")).alias("big"))
    a = p.join(e.toDF("small", "v"), "small")
    both = a.join(e.toDF("big", "v"), ["big", "v"], "left_semi")
    return both.join(weight, "v").groupBy(*KEY).agg(F.count(F.lit(1)).alias("common"), F.sum("aa").alias("adamic_adar"))


def pair_features(edges: graph.Edges, pairs: DataFrame) -> DataFrame:
    """``pairs`` with degrees of both ends, common successors and all similarities; nodes outside the graph count 0.

    Added columns: in_i, out_i, in_j, out_j, common, adamic_adar, jaccard, pref_attach, volume, friends. Copies of a
    pair stay; every pair column passes through. friends is 1 / (deg i + deg j - 1) rounded to 3 digits, null when that is
    1 / 0 or the nodes are unknown.
    """
    edges, pairs = graph.as_graph(edges), written(pairs)
    deg = graph.degrees(edges).select("node", "in_degree", "out_degree")
    cs = common_successors(edges, pairs)
    j = pairs.join(deg.toDF("Source", "in_i", "out_i"), "Source", "left").join(deg.toDF("Target", "in_j", "out_j"), "Target", "left").join(cs, KEY, "left")
    j = j.fillna(0, ["in_i", "out_i", "in_j", "out_j", "common"]).fillna(0.0, ["adamic_adar"])
    union = F.col("out_i") + F.col("out_j") - F.col("common")
    di, dj = F.col("in_i") + F.col("out_i"), F.col("in_j") + F.col("out_j")
    return j.select(
        *[F.col(c) for c in pairs.columns], "in_i", "out_i", "in_j", "out_j", "common", "adamic_adar",
        F.when(union > 0, F.col("common") / union).otherwise(F.lit(0.0)).alias("jaccard"),
        (di * dj).alias("pref_attach"), (F.col("out_i") + F.col("out_j")).alias("volume"),
        F.when(di + dj - 1 > 0, F.round(F.lit(1.0) / (di + dj - 1), 3)).alias("friends"),
    )


SIMILARITIES = {"common_neighbors": "common", "jaccard": "jaccard", "adamic_adar": "adamic_adar", "preferential_attachment": "pref_attach", "friendtns": "friends"}


def similarity(edges: graph.Edges, pairs: DataFrame, method: str) -> DataFrame:
    """(Source, Target, score) by name; unused features are pruned from the plan. Unknown names raise ValueError."""
    if method not in SIMILARITIES:
        raise ValueError(f"unknown similarity {method!r}")
    return pair_features(edges, pairs.select(*KEY)).select(*KEY, F.col(SIMILARITIES[method]).alias("score"))


HEURISTICS = (
    "katz", "in_degree_i_to_j", "out_degree_i_to_j", "in_degree_j_to_i", "out_degree_j_to_i", "common_nbrs",
    "volume_i", "volume_j", "adamic_adar", "pref_attach", "jaccards_coef",
)


def heuristics(edges: graph.Edges, pairs: DataFrame, label: str = "Class", with_katz: bool = True, **katz_args) -> DataFrame:
    """The 11 heuristic features (10 without katz) of each pair, keys first, label last; nulls become 0."""
    edges = graph.as_graph(edges)
    f = pair_features(edges, pairs.select(*KEY, label))
    f = f.select(
        *KEY, label, F.col("in_i").alias("in_degree_i_to_j"), F.col("out_i").alias("out_degree_i_to_j"), F.col("in_j").alias("in_degree_j_to_i"),
        F.col("out_j").alias("out_degree_j_to_i"), F.col("common").alias("common_nbrs"), F.col("volume").alias("volume_i"),
        F.col("volume").alias("volume_j"), "adamic_adar", "pref_attach", F.col("jaccard").alias("jaccards_coef"),
    )
    if with_katz:
        k = graph.katz(edges, **katz_args)
        f = f.join(k.withColumnRenamed("node", "Source"), "Source", "left").fillna(0.0, ["katz"])
    return f.select(*KEY, *[h for h in HEURISTICS if h != "katz" or with_katz], label)


def link_stats_columns(edges: graph.Edges, pairs: DataFrame) -> DataFrame:
    """``pairs`` with Hub (in-degree of Target) and Common (common successors) in the train graph."""
    f = pair_features(edges, pairs)
    return f.select(*[F.col(c) for c in pairs.columns], F.col("in_j").alias("Hub"), F.col("common").alias("Common"))


def katz_pairs(edges: graph.Edges, pairs: DataFrame, beta: float = 0.05) -> DataFrame:
    """(Source, Target, katz_pair): beta * paths of length 1 + beta**2 * paths of length 2 (Liben-Nowell, Kleinberg)."""
    edges = graph.as_graph(edges)
    e = edges.edges
    p = written(pairs.select(*KEY).where("Source is not null and Target is not null").distinct())
    one = p.join(e, KEY, "left_semi").withColumn("n1", F.lit(1))
    # expand the side with fewer edges: successors of Source or predecessors of Target
    deg = graph.degrees(edges)
    p2 = p.join(deg.select(F.col("node").alias("Source"), F.col("out_degree").alias("o")), "Source").join(deg.select(F.col("node").alias("Target"), F.col("in_degree").alias("i")), "Target")
    fwd = p2.where("o <= i").join(e.toDF("Source", "m"), "Source").join(e.toDF("m", "Target"), ["m", "Target"], "left_semi")
    bwd = p2.where("o > i").join(e.toDF("m", "Target"), "Target").join(e.toDF("Source", "m"), ["Source", "m"], "left_semi")
    two = fwd.select(*KEY).unionByName(bwd.select(*KEY)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n2"))
    out = p.join(one, KEY, "left").join(two, KEY, "left").fillna(0, ["n1", "n2"])
    return out.select(*KEY, (F.lit(beta) * F.col("n1") + F.lit(beta * beta) * F.col("n2")).alias("katz_pair"))


def hadamard(pairs: DataFrame, emb: DataFrame, node: str = "node", vector: str = "emb") -> DataFrame:
    """``pairs`` with ``hadamard``, the element-wise product of both ends' vectors; pairs with an unknown end are left out."""
    a = emb.select(F.col(node).alias("Source"), F.col(vector).alias("__a"))
    b = emb.select(F.col(node).alias("Target"), F.col(vector).alias("__b"))
    j = pairs.join(a, "Source").join(b, "Target")
    return j.select(*[F.col(c) for c in pairs.columns], F.zip_with("__a", "__b", lambda x, y: x * y).alias("hadamard"))
