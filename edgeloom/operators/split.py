"""Train and test edges: predictable-edge filter, known nodes, calendar and day splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.session import written

KEY = ["Source", "Target"]


def nodes(edges: DataFrame) -> DataFrame:
    """(node): distinct endpoints."""
    ends = F.explode(F.array("Source", "Target")).alias("node")
    return edges.select(ends).where("node is not null").distinct()


def known_nodes(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose endpoints both occur in train."""
    n = written(nodes(train))
    a, b = n.withColumnRenamed("node", "Source"), n.withColumnRenamed("node", "Target")
    return test.join(a, "Source", "left_semi").join(b, "Target", "left_semi").select(*test.columns)


def filter_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Predictable test rows: both endpoints known, the edge itself not in train. Copies of test rows stay."""
    train = written(train)  # read for its edges and its nodes
    new = test.join(train.select(*KEY).distinct(), KEY, "left_anti").select(*test.columns)
    return known_nodes(new, train)


def calendar_split(edges: DataFrame, year: int = 2006, months: int = 3, test_year: int = 2007, name: str = "part") -> DataFrame:
    """train: that year, or the first months of any year; test: later months of the test year; others are left out."""
    y, m = F.year("Date"), F.month("Date")
    part = F.when((y == year) | (m <= months), "train").when((y == test_year) & (m > months), "test")
    return edges.withColumn(name, part).where(F.col(name).isNotNull())


def day_split(edges: DataFrame, name: str = "part") -> DataFrame:
    """train: rows on the day of month of the first row (earliest Date); test: the others; null dates are left out."""
    first = edges.where("Date is not null").agg(F.dayofmonth(F.min("Date")).alias("__d"))
    # one row
    out = edges.where("Date is not null").crossJoin(F.broadcast(first))
    return out.withColumn(name, F.when(F.dayofmonth("Date") == F.col("__d"), "train").otherwise("test")).drop("__d")


def induced(edges: DataFrame, node_set: DataFrame) -> DataFrame:
    """Edges with both endpoints in (node)."""
    n = node_set.select("node").distinct()
    a, b = n.withColumnRenamed("node", "Source"), n.withColumnRenamed("node", "Target")
    return edges.join(a, "Source", "left_semi").join(b, "Target", "left_semi").select(*edges.columns)


def edge_subgraph(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges (with their Date) whose (Source, Target) is in ``chosen``."""
    return edges.join(chosen.select(*KEY).distinct(), KEY, "left_semi").select(*edges.columns)
