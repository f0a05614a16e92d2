"""Synthetic sources: random digraphs, gaussian matrices, token corpora. All seeded by hashing."""

from __future__ import annotations

from math import log, pi, sqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.functions.hashing import hash_int
from edgeloom.session import cut, cut_counted


def gnp_digraph(spark: SparkSession, n: int, p: float, seed: int = 1) -> DataFrame:
    """G(n, p), directed, without self-loops, as edges with Class 1 and Date 1.

    Per source node the gaps between its targets are geometric (Batagelj and Brandes, 2005), so the work is in proportion to
    the edges. Gap j of a node comes from a hash of both, so any partitioning gives the same graph. Gaps are drawn in
    blocks; nodes whose gaps do not yet pass the last target draw another one.
    """
    if not 0 <= p <= 1:
        raise ValueError("p must be in 0..1")
    ids = spark.range(n)
    if p <= 0 or n < 2:
        at = ids.select(F.col("id").alias("s"), F.lit(0).cast("bigint").alias("at")).where("false")
    elif p >= 1:
        at = ids.select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(n - 2))).alias("at"))
    else:
        block = int(n * p + 6 * sqrt(n * p)) + 16
        open_, first, parts = ids.select(F.col("id").alias("s"), F.lit(-1).cast("bigint").alias("last")), 0, []
        while True:
            j = open_.withColumn("j", F.explode(F.sequence(F.lit(first), F.lit(first + block - 1))))
            u = (hash_int(seed, "s", "j") + 1) / F.lit(float((1 << 32) + 1))
            gap = F.least(F.floor(F.log(u) / F.lit(log(1 - p))) + 1, F.lit(n)).cast("bigint")
            mine = Window.partitionBy("s").orderBy("j")
            placed = cut(j.withColumn("at", F.col("last") + F.sum(gap).over(mine)))
            parts.append(placed.where(F.col("at") < n - 1).select("s", "at"))
            open_, (more,) = cut_counted(placed.groupBy("s").agg(F.max("at").alias("last")).where(F.col("last") < n - 1))
            if not more:
                break
            first += block
        at = parts[0]
        for x in parts[1:]:
            at = at.unionByName(x)
    target = F.col("at") + (F.col("at") >= F.col("s")).cast("bigint")  # skips the node itself
    return at.select(F.lit(1).alias("Date"), F.col("s").cast("string").alias("Source"), target.cast("string").alias("Target"), F.lit(1).alias("Class"))


def gaussian_matrix(spark: SparkSession, rows: int, columns: int = 100, seed: int = 1) -> DataFrame:
    """``columns`` standard-normal features named by number and a random binary Class.

    Each cell comes from two hashes of its place (Box and Muller, 1958), so any partitioning gives the same matrix.
    """
    unit = F.lit(float((1 << 32) + 1))
    u = lambda i, k: (hash_int(seed, "id", F.lit(i), F.lit(k)) + 1) / unit
    cols = [(F.sqrt(F.lit(-2.0) * F.log(u(i, "r"))) * F.cos(F.lit(2 * pi) * u(i, "a"))).alias(str(i)) for i in range(columns)]
    return spark.range(rows).select(*cols, F.pmod(hash_int(seed, "id", F.lit("Class")), F.lit(2)).cast("int").alias("Class"))


def token_corpus(spark: SparkSession, sentences: int, tokens: int = 10, letters: int = 4, seed: int = 1) -> DataFrame:
    """Sentences of random lower-case tokens: (id, sentence ARRAY<STRING>)."""
    ids = spark.range(sentences)
    words = [
        F.concat(*[F.chr(F.lit(97) + F.pmod(hash_int(seed, "id", F.lit(t), F.lit(k)), F.lit(26))) for k in range(letters)])
        for t in range(tokens)
    ]
    return ids.select("id", F.array(*words).alias("sentence"))
