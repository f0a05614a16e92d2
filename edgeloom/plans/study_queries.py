"""Whole studies as queries: from edges to quality and link-statistics rows. Learned models, so without SQL."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.hashing import sql_hash_int
from edgeloom.functions.ids import id_number
from edgeloom.operators import embed, sample, split
from edgeloom.plans import experiments as ex
from edgeloom.plans import graphs as g
from edgeloom.plans.graph_queries import metrics_sql, vectors_sql
from edgeloom.sources import generators
from edgeloom.sources.edges import dedup_first
from edgeloom.session import cut
from edgeloom.sources.tables import load


KATZ = 8  # rounds of Katz on whole train graphs, where it need not converge


def _sizes(edges: DataFrame) -> list[int]:
    n = edges.count()
    return [n // 4, n // 2]


def study_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Forest on all heuristics, trained on a quarter and on half of the call edges, tested on the predictable rest."""
    e = cut(g.call_numbers(spark, d))
    return ex.sweep_sizes(e, _sizes(e), families=["heuristic"], katz_rounds=KATZ)


def study_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Forests on node2vec and deepwalk features of the growth edges."""
    e = cut(g.growth(spark, d))
    return ex.sweep_sizes(e, _sizes(e)[1:], families=["node2vec", "deepwalk"])


def study_calendar(spark: SparkSession, d: str) -> DataFrame:
    e = cut(g.growth(spark, d))
    return ex.sweep_sizes(e, _sizes(e)[1:], mode="calendar", families=["heuristic"], katz_rounds=KATZ)


def study_days(spark: SparkSession, d: str) -> DataFrame:
    """Trained on the first day of the log, tested on every other day."""
    c = load(spark, d, "dynamobi").where("Class = 1 and Date is not null")
    c = c.select("Date", F.date_format("Date", "MM-dd").alias("day"), id_number("Source").alias("Source"), id_number("Target").alias("Target"), "Class")
    e = dedup_first(c.where("Source is not null and Target is not null"), ["day", "Source", "Target"], [F.col("Date")])
    return ex.train_one_day(cut(e), "07-01", 10**9, katz_rounds=KATZ)


def study_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Link statistics per outcome of each family's forest, half of the growth edges as train."""
    e = cut(g.growth(spark, d))
    return ex.error_buckets(e, _sizes(e)[1:], ex.FAMILIES, katz_rounds=KATZ)


def study_grid(spark: SparkSession, d: str) -> DataFrame:
    """node2vec on the citations per p and q, with walks of ten nodes."""
    e = g.citations(spark, d).withColumn("Class", F.lit(1)).withColumn("Date", F.lit(None).cast("timestamp_ntz"))
    train = cut(sample.sample_random(e, e.count() // 2, 42))
    test = cut(split.filter_test(train, e.join(train, split.KEY, "left_anti").select(*e.columns)))
    a, b = sample.with_negatives(train, test)
    return ex.node2vec_grid(cut(a), cut(b), walk_length=10)


def study_random_graphs(spark: SparkSession, d: str) -> DataFrame:
    return ex.random_graph_metrics(spark, [500, 1000], 0.01)


def study_random_links(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the heuristics on a random graph, where there is nothing to learn."""
    e = cut(generators.gnp_digraph(spark, 1000, 0.01))
    return ex.sweep_sizes(e, _sizes(e), families=["heuristic"], katz_rounds=KATZ)


def embed_stress(spark: SparkSession, d: str) -> DataFrame:
    """Skip-gram over a corpus of random tokens, five rounds, eight tasks side by side."""
    corpus = generators.token_corpus(spark, 20_000).select(F.col("sentence").alias("walk"))
    v = embed.train_embedding(corpus, size=100, window=5, iterations=5, partitions=8)
    return v.agg(F.count(F.lit(1)).alias("tokens"), F.min(F.size("emb")).alias("size"), F.count(F.when(F.exists("emb", lambda x: F.isnan(x)), 1)).alias("broken"))


def gen_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = generators.gaussian_matrix(spark, 1000)
    return m.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in m.columns[:-1]], "Class")


def gen_corpus(spark: SparkSession, d: str) -> DataFrame:
    return generators.token_corpus(spark, 1000).select("id", F.concat_ws(" ", "sentence").alias("sentence"))


QUERIES = {
    "study_sizes": study_sizes, "study_embeddings": study_embeddings, "study_calendar": study_calendar, "study_days": study_days,
    "study_grid": study_grid, "study_random_links": study_random_links, "embed_stress": embed_stress, "study_buckets": study_buckets, "study_random_graphs": study_random_graphs, "gen_matrix": gen_matrix, "gen_corpus": gen_corpus,
}

def _gnp(n: int, p: float) -> str:
    """gn: the edges of G(n, p), from more gaps than any node needs."""
    draws = int(n * p + 12 * sqrt(n * p)) + 30
    return f"""dr as (select s, j, least(floor(ln(({sql_hash_int(1, 's', 'j')} + 1) / {_UNIT}::double) / ln(1 - {p}::double)) + 1, {n}) gap from range({n}) a(s), range({draws}) b(j)),
    pl as (select s, sum(gap) over (partition by s order by j) - 1 at_ from dr),
    gn as (select cast(s as varchar) "Source", cast(cast(at_ + case when at_ >= s then 1 else 0 end as bigint) as varchar) "Target" from pl where at_ < {n - 1})"""


_UNIT = float((1 << 32) + 1)


def _cell(i: int) -> str:
    u = lambda k: f"({sql_hash_int(1, 'id', repr(str(i)), repr(k))} + 1) / {_UNIT}::double"
    return f'round(sqrt(-2.0 * ln({u("r")})) * cos({2 * pi}::double * {u("a")}), 6) + 0.0 as "{i}"'


ORACLE = {
    "study_random_graphs": " union all ".join(f"select * from (with {_gnp(n, 0.01)}, {vectors_sql('gn')} select {n} size, * from ({metrics_sql()}) m) w" for n in (500, 1000)),
    "gen_matrix": f"select {', '.join(_cell(i) for i in range(100))}, cast({sql_hash_int(1, 'id', repr('Class'))} % 2 as int) \"Class\" from range(1000) r(id)",
    "embed_stress": "select count(*) tokens, cast(100 as int) size, 0::bigint broken from (select distinct string_agg(chr(97 + cast(cast('0x' || substr(md5('1|' || id || '|' || t || '|' || k), 1, 8) as bigint) % 26 as int)), '' order by k) w "
    "from range(20000) a(id), range(10) b(t), range(4) c(k) group by id, t) q",
    "gen_corpus": "select id, string_agg(w, ' ' order by t) sentence from (select id, t, string_agg(chr(97 + cast(cast('0x' || substr(md5('1|' || id || '|' || t || '|' || k), 1, 8) as bigint) % 26 as int)), '' order by k) w "
    "from range(1000) a(id), range(10) b(t), range(4) c(k) group by id, t) q group by id",
}
