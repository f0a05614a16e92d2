"""Studies of how well future links are foreseen: feature families, size sweeps, day-by-day tests, error buckets, random graphs, p/q grids.

Each returns a result frame in one of the report schemas. The loops run over a handful of sizes, days or families; every
step inside is a distributed plan. Reported sizes are true numbers of positive train edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import embed, model, order, pairs, report, sample, split
from edgeloom.operators.graph import Edges, Graph
from edgeloom.operators.metrics import degree_metrics
from edgeloom.operators.split import KEY
from edgeloom.session import cut
from edgeloom.sources import generators

FAMILIES = ("heuristic", "node2vec", "deepwalk")
QUALITY = ("precision", "recall", "roc_auc", "accuracy", "f1_score")
SIDE_BY_SIDE = 5_000_000  # numbers of all vectors that are fitted at the same time: the driver gathers them


def _walked(family: str, p: float = 1.0, q: float = 1.0, **_) -> str:
    """The family whose walks, vectors and forest these are: with p = q = 1 the walks of node2vec are those of deepwalk, step by step."""
    return "deepwalk" if family == "node2vec" and p == 1 and q == 1 else family


def _vectors(graph: Edges, family: str, **fit) -> DataFrame:
    return (embed.node2vec if family == "node2vec" else embed.deepwalk)(graph, **fit)


def family_features(graph: Edges, frame: DataFrame, family: str, with_katz: bool = True, katz_rounds: int | None = None, size: int = 128, seed: int = 42, emb: DataFrame | None = None, **walk) -> tuple[DataFrame, list[str]]:
    """(features of each row of ``frame``, their names) from the train graph; embedding rows need both ends in it.

    ``frame`` has Source, Target, Class; every other column is dropped except ``part`` and ``day``. ``katz_rounds``
    bounds the rounds of Katz, which need not converge on every graph. ``emb``: the vectors, where they are fitted already.
    """
    extra = [c for c in ("part", "day") if c in frame.columns]
    base = frame.select(*KEY, "Class", *extra)
    keyed = base.select(*KEY, "Class").distinct()
    if family == "heuristic":
        f = pairs.heuristics(graph, keyed, with_katz=with_katz, iterations=katz_rounds)
        names = [h for h in pairs.HEURISTICS if with_katz or h != "katz"]
    elif family in ("node2vec", "deepwalk"):
        emb = emb if emb is not None else cut(_vectors(graph, family, seed=seed, size=size, **walk))
        f, names = embed.embedding_features(keyed, emb, size), [f"e{i}" for i in range(size)]
    else:
        raise ValueError(f"unknown family {family!r}")
    return (f if not extra else base.join(f, [*KEY, "Class"])), names


def evaluate_families(train: DataFrame, test: DataFrame, families: Sequence[str] = FAMILIES, kind: str = "rf", seed: int = 42, trees: int = 13, depth: int = 20, group: Sequence[str] = (), graph: Graph | None = None, **features) -> DataFrame:
    """(size, model, method, <group>, quality...): each family fitted on ``train`` and applied to ``test``.

    Both frames have Source, Target, Class with their negatives; the graph is the positive part of ``train``, written unless it is given.
    """
    graph = graph or Graph(train.where("Class = 1"))
    size = graph.size
    parts = []
    same: dict[str, DataFrame] = {}
    for fam in families:
        if (walked := _walked(fam, **features)) in same:
            parts.append(same[walked].withColumn("method", F.lit(fam)))
            continue
        both = train.select(*KEY, "Class").withColumn("part", F.lit("train")).withColumn("day", F.lit(None).cast("string"))
        t = test.select(*KEY, "Class", *[c for c in group if c == "day"]).withColumn("part", F.lit("test"))
        f, names = family_features(graph, both.unionByName(t, allowMissingColumns=True), fam, seed=seed, **features)
        f = cut(f)
        got = model.fit_predict(f.where("part = 'train'"), f.where("part = 'test'"), names, model=kind, trees=trees, depth=depth, seed=seed)
        same[walked] = cut(model.evaluate(got, list(group)).select(F.lit(size).alias("size"), F.lit(kind).alias("model"), F.lit(fam).alias("method"), *group, *QUALITY))
        parts.append(same[walked])
    return report.union_all(parts)


def sweep_sizes(edges: DataFrame, sizes: Sequence[int], sampling: str = "random", mode: str = "prefix", other: DataFrame | None = None, seed: int = 42, **kw) -> DataFrame:
    """Quality per train size.

    mode 'prefix' trains on a sample and tests on the rest of the same edges; 'other_day' tests on ``other``;
    'calendar' ignores the sizes but one per entry and splits by the calendar rule; test rows keep to predictable edges.
    """
    parts = []
    for n in sizes:
        if mode == "calendar":
            s = split.calendar_split(edges)
            train, rest = s.where("part = 'train'").drop("part"), s.where("part = 'test'").drop("part")
            train = sample.sample_graph(train, n, sampling, seed)
        else:
            train = sample.sample_graph(edges, n, sampling, seed)
            rest = other if mode == "other_day" else edges.join(train.select(*KEY), KEY, "left_anti").select(*edges.columns)
        train = cut(train)
        test = cut(split.filter_test(train, rest))
        a, b = sample.with_negatives(train, test, seed)
        parts.append(evaluate_families(cut(a), cut(b), seed=seed, **kw))
    return report.union_all(parts)


def train_one_day(edges: DataFrame, day: str, size: int, families: Sequence[str] = ("heuristic",), seed: int = 42, **kw) -> DataFrame:
    """(day, model, method, quality...): trained on a sample of one day, tested on each other day in one grouped pass.

    ``edges`` has a string column ``day``.
    """
    train = cut(sample.sample_random(edges.where(F.col("day") == day).drop("day"), size, seed))
    test = cut(split.filter_test(train, edges.where(F.col("day") != day)))
    a, neg = sample.with_negatives(train, test.drop("day"), seed)
    days = test.select("day").distinct()
    # a test negative belongs to one day, by hash
    ranked = order.global_rank(days, ["day"], "ix")
    n = max(1, ranked.count())
    from edgeloom.functions.hashing import hash_int

    neg = neg.where("Class = 0").withColumn("ix", F.pmod(hash_int(seed, F.lit("day"), *KEY), F.lit(n)) + 1).join(F.broadcast(ranked), "ix")  # a row per day
    frame = test.select(*KEY, "Class", "day").unionByName(neg.select(*KEY, "Class", "day"))
    got = evaluate_families(cut(a), cut(frame), families, seed=seed, group=["day"], **kw)
    return got.select("day", "model", "method", *QUALITY)


def error_buckets(edges: DataFrame, sizes: Sequence[int], families: Sequence[str] = FAMILIES, other: DataFrame | None = None, seed: int = 42, trees: int = 13, depth: int = 20, **features) -> DataFrame:
    """(Size, Method, Split, Common, Hub, pct_common_0, NUnique): link statistics per outcome of each family's forest."""
    parts = []
    for n in sizes:
        train = cut(sample.sample_random(edges, n, seed))
        rest = other if other is not None else edges.join(train.select(*KEY), KEY, "left_anti").select(*edges.columns)
        test = cut(split.filter_test(train, rest))
        a, b = (cut(x) for x in sample.with_negatives(train, test, seed))
        size = train.count()
        links = Graph(train)
        same: dict[str, DataFrame] = {}
        for fam in families:
            if (walked := _walked(fam, **features)) in same:
                parts.append(same[walked].withColumn("Method", F.lit(fam)))
                continue
            both = a.select(*KEY, "Class").withColumn("part", F.lit("train")).unionByName(b.select(*KEY, "Class").withColumn("part", F.lit("test")))
            f, names = family_features(links, both, fam, seed=seed, **features)
            f = cut(f)
            got = model.fit_predict(f.where("part = 'train'"), f.where("part = 'test'"), names, trees=trees, depth=depth, seed=seed)
            stats = model.link_stats(pairs.link_stats_columns(links, got.select(*KEY, "Class", "Predicted")))
            same[walked] = cut(stats.select(F.lit(size).alias("Size"), F.lit(fam).alias("Method"), *stats.columns))
            parts.append(same[walked])
    return report.union_all(parts)


def node2vec_grid(train: DataFrame, test: DataFrame, ps: Sequence[float] = (0.25, 1, 2), qs: Sequence[float] = (1,), seed: int = 42, size: int = 128, **kw) -> DataFrame:
    """Quality of node2vec features per (p, q).

    A skip-gram fit keeps few cores busy, so those of the settings run side by side, as many as have at most SIDE_BY_SIDE numbers in their vectors.
    """
    graph = Graph(train.where("Class = 1"))
    settings = [(float(p), float(q)) for p in ps for q in qs]
    numbers = graph.degrees.count() * size
    graph.held  # noqa: B018  sent once, before the settings share it
    fit = {k: kw.pop(k) for k in ("walk_length", "num_walks", "window", "iterations", "partitions") if k in kw}
    with ThreadPoolExecutor(max(1, min(len(settings), SIDE_BY_SIDE // max(1, numbers)))) as pool:
        vectors = list(pool.map(lambda x: cut(_vectors(graph, "node2vec", seed=seed, size=size, p=x[0], q=x[1], **fit)), settings))
    parts = []
    for (p, q), emb in zip(settings, vectors, strict=True):
        train.sparkSession.sparkContext._jvm.System.gc()  # what the fits left on the driver
        got = evaluate_families(train, test, ["node2vec"], seed=seed, graph=graph, size=size, emb=emb, p=p, q=q, **kw)
        parts.append(got.withColumn("p", F.lit(p)).withColumn("q", F.lit(q)))
    return report.union_all(parts)


def random_graph_metrics(spark: SparkSession, sizes: Sequence[int], p: float, seed: int = 1) -> DataFrame:
    """(size, metrics...) of G(n, p) for each number of nodes."""
    return report.union_all([degree_metrics(generators.gnp_digraph(spark, n, p, seed)).select(F.lit(n).alias("size"), "*") for n in sizes])


def show_quality(results: DataFrame, n: int = 50) -> None:
    """Print quality rows, four decimals."""
    results.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in results.dtypes]).show(n, truncate=False)
