"""Extension: incremental edge ingestion. A stream of edge rows becomes distinct edges, late copies dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_edges(stream: DataFrame, ts: str = "Date", late: str = "1 day") -> DataFrame:
    """First sight of each (Source, Target) within the watermark; state is bounded by ``late``."""
    s = stream.where("Source is not null and Target is not null")
    return s.withWatermark(ts, late).dropDuplicatesWithinWatermark(["Source", "Target"])


def edges_per_window(stream: DataFrame, ts: str = "Date", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Edge rows per time window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("edges"))
