"""Node vectors from walks, and pair features from node vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import pairs as pair_ops
from edgeloom.operators import skipgram
from edgeloom.operators import walks as walk_ops
from edgeloom.session import written


MAX_NUMBERS = 200_000_000  # numbers of all vectors together: a task of the fit may hold them all
WALKS_PER_TASK = 200_000


def train_embedding(walks: DataFrame, size: int = 128, window: int = 4, iterations: int = 4, partitions: int | None = None, seed: int = 42) -> DataFrame:
    """(node, emb ARRAY<FLOAT>): skip-gram over walks.

    As many ``partitions`` train side by side and are averaged after each iteration (``skipgram``), with the same result however the
    walks come. Without ``partitions`` there is one per WALKS_PER_TASK walks. A task holds the vectors of the nodes it visits, all of
    them at worst, so the fit refuses more than MAX_NUMBERS.
    """
    walks = written(walks.select("walk"))
    words = walks.select(F.explode("walk").alias("w")).agg(F.approx_count_distinct("w", 0.02)).first()[0]
    if words * size > MAX_NUMBERS:
        raise ValueError(f"about {words} vectors of {size} numbers are more than {MAX_NUMBERS} numbers")
    if partitions is None:
        partitions = min(-(-max(1, walks.count()) // WALKS_PER_TASK), walks.sparkSession.sparkContext.defaultParallelism)
    return skipgram.train(walks, size, window, iterations, partitions, seed, words * size)


def deepwalk(edges: DataFrame, walk_length: int = 80, num_walks: int = 10, seed: int = 42, **fit) -> DataFrame:
    return train_embedding(walk_ops.uniform_walks(edges, walk_length, num_walks, seed), seed=seed, **fit)


def node2vec(edges: DataFrame, walk_length: int = 80, num_walks: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 42, **fit) -> DataFrame:
    return train_embedding(walk_ops.node2vec_walks(edges, walk_length, num_walks, p, q, seed), seed=seed, **fit)


def embedding_features(pairs: DataFrame, emb: DataFrame, size: int, label: str = "Class") -> DataFrame:
    """Keys, one feature column e0.. per dimension of the Hadamard product, label last."""
    h = pair_ops.hadamard(pairs.select("Source", "Target", label), emb)
    return h.select("Source", "Target", *[F.col("hadamard")[i].alias(f"e{i}") for i in range(size)], label)
