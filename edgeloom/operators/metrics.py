"""Graph metric summaries: minimum, maximum, mean and population deviation of per-node vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import graph
from edgeloom.session import cut


def _summary(name: str, column: str) -> list:
    c = F.col(column)
    return [
        F.round(F.min(c).cast("double"), 6).alias(f"min_{name}"), F.round(F.max(c).cast("double"), 6).alias(f"max_{name}"),
        F.round(F.avg(c), 6).alias(f"avg_{name}"), F.round(F.stddev_pop(c), 6).alias(f"std_{name}"),
    ]


def degree_metrics(edges: graph.Edges) -> DataFrame:
    """One row: nodes, edges, and summaries of in-degree, out-degree, clustering and neighbour degree."""
    edges = graph.as_graph(edges)
    v = graph.degrees(edges).join(graph.clustering(edges), "node").join(graph.average_neighbor_degree(edges), "node")
    return v.agg(
        F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges"),
        *_summary("in_degree", "in_degree"), *_summary("out_degree", "out_degree"),
        *_summary("clustering", "clustering"), *_summary("neighbor_degree", "avg_neighbor_degree"),
    )


def graph_metrics(edges: graph.Edges, centralities: bool = False, pivots: int = 10) -> DataFrame:
    """``degree_metrics`` with strong and weak component sizes; optionally betweenness and closeness summaries."""
    edges = graph.as_graph(edges)
    out = degree_metrics(edges)
    for name, comp in (("scc", graph.strong_components(edges)), ("wcc", graph.weak_components(edges))):
        size = cut(comp).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        out = out.join(F.broadcast(size.agg(F.count(F.lit(1)).alias(f"{name}_count"), *_summary(name, "n"))))  # one row
    if centralities:
        b, c = cut(graph.betweenness(edges, pivots)), cut(graph.closeness(edges))
        out = out.join(F.broadcast(b.agg(*_summary("betweenness", "betweenness")))).join(F.broadcast(c.agg(*_summary("closeness", "closeness"))))
    return out
