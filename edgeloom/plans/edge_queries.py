"""Queries on sources, splits, samples and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import moments
from edgeloom.functions.hashing import sql_hash_int, sql_key_hash
from edgeloom.functions.ids import id_text, sql_id_text
from edgeloom.operators import graph, model, order, report, sample, split
from edgeloom.plans import graphs as g
from edgeloom.plans.graphs import KEY, sql_degrees, sql_nodes, with_
from edgeloom.session import cut, scratch
from edgeloom.sources import edges as src
from edgeloom.sources import generators
from edgeloom.sources.tables import load

SEED = 42
_S, _T = sql_id_text('"Source"'), sql_id_text('"Target"')


def _size(e: DataFrame, share: float) -> int:
    return int(e.count() * share)


def dedup_edges(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each pair with its other columns: earliest Date, then smallest call_id."""
    rows = load(spark, d, "dynamobi").select("Date", id_text("Source").alias("Source"), id_text("Target").alias("Target"), "call_id", "Class", "split", "feed")
    return src.dedup_first(rows.where("Source is not null and Target is not null"), KEY, [F.col("Date"), F.col("call_id")])


def src_edges_date_join(spark: SparkSession, d: str) -> DataFrame:
    return src.citation_edges(load(spark, d, "hepph_edges"), load(spark, d, "hepph_dates"))


def src_edges_social(spark: SparkSession, d: str) -> DataFrame:
    """Dateless edges in a seeded random order, kept as a rank."""
    e = cut(src.social_edges(load(spark, d, "youtube_growth")))
    return order.global_rank(e, order.shuffled(SEED, *KEY))


def src_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges per day, one scan for all days."""
    c = load(spark, d, "dynamobi").where('Class = 1 and Date is not null').select(F.col("Date").cast("date").alias("day"), id_text("Source").alias("s"), id_text("Target").alias("t"))
    return c.where("s is not null and t is not null").distinct().groupBy("day").agg(F.count(F.lit(1)).alias("edges"))


def edges_per_month(spark: SparkSession, d: str) -> DataFrame:
    return g.growth(spark, d).groupBy(F.year("Date").alias("year"), F.month("Date").alias("month")).agg(F.count(F.lit(1)).alias("edges"))


def distinct_nodes_profile(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct Sources and Targets, and rows, per split."""
    t = load(spark, d, "dynamobi").select("split", id_text("Source").alias("s"), id_text("Target").alias("t"))
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("s").alias("sources"), F.countDistinct("t").alias("targets"))


def describe_debug(spark: SparkSession, d: str) -> DataFrame:
    return report.describe(load(spark, d, "debug"), ["source_in", "source_out", "target_in", "target_out", "Hub", "Common"])


def time_split_calendar(spark: SparkSession, d: str) -> DataFrame:
    return split.calendar_split(g.growth(spark, d))


def time_split_day(spark: SparkSession, d: str) -> DataFrame:
    return split.day_split(g.calls(spark, d))


def prefix_split(spark: SparkSession, d: str) -> DataFrame:
    """First quarter of the growth edges by date as train, the rest as test."""
    e = g.growth(spark, d)
    return order.fraction_split(e, share=0.25, **order.by_time("Date", *KEY))


def fraction_split(spark: SparkSession, d: str) -> DataFrame:
    return order.fraction_split(g.calls(spark, d), share=0.25, **order.by_hash(SEED, *KEY))


def capped_split(spark: SparkSession, d: str) -> DataFrame:
    """Like fraction_split, with the test part capped at 500,000 rows after the train prefix."""
    return order.fraction_split(g.growth(spark, d), share=0.25, cap=500_000, **order.by_hash(SEED, *KEY))


def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    """Three quarters by date as train; of the rest the predictable edges."""
    e = cut(order.fraction_split(g.growth(spark, d), share=0.75, **order.by_time("Date", *KEY)))  # read three times
    train = e.where("part = 'train'")
    return train.unionByName(split.filter_test(train, e.where("part = 'test'")))


def filter_test(spark: SparkSession, d: str) -> DataFrame:
    return g.as_text(split.filter_test(g.call_numbers(spark, d, "train"), g.test_pairs(spark, d)))


def known_nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.as_text(split.known_nodes(g.call_numbers(spark, d, "test"), g.call_numbers(spark, d, "train")).select(*KEY))


def top_targets(spark: SparkSession, d: str) -> DataFrame:
    """The ten Targets with most edges; ties by id."""
    e = g.as_text(g.call_numbers(spark, d))
    return e.groupBy("Target").agg(F.count(F.lit(1)).alias("edges")).orderBy(F.desc("edges"), "Target").limit(10)


def sample_time(spark: SparkSession, d: str) -> DataFrame:
    e = cut(g.calls(spark, d))
    return sample.sample_time(e, _size(e, 0.25))


def sample_random(spark: SparkSession, d: str) -> DataFrame:
    e = cut(g.calls(spark, d))
    return sample.sample_random(e, _size(e, 0.25), SEED)


def sample_node(spark: SparkSession, d: str) -> DataFrame:
    e = cut(g.growth(spark, d))
    return sample.sample_node(e, _size(e, 0.1), SEED, batch=100)


def sample_bfs(spark: SparkSession, d: str) -> DataFrame:
    e = cut(g.growth(spark, d))
    return sample.sample_traverse(e, _size(e, 0.1), "bfs", SEED)


def sample_dfs(spark: SparkSession, d: str) -> DataFrame:
    e = cut(g.growth(spark, d))
    return sample.sample_traverse(e, _size(e, 0.1), "dfs", SEED)


def sample_bfs_full(spark: SparkSession, d: str) -> DataFrame:
    e = cut(g.growth(spark, d))
    return sample.sample_search(e, _size(e, 0.1), "bfs", SEED)


def sample_dfs_full(spark: SparkSession, d: str) -> DataFrame:
    e = cut(g.growth(spark, d))
    return sample.sample_search(e, _size(e, 0.1), "dfs", SEED)


def src_friendships(spark: SparkSession, d: str) -> DataFrame:
    """Written as a raw file of friendship pairs and read back: no dates, copies kept, comments skipped."""
    path = scratch(spark)
    pairs = load(spark, d, "youtube_growth").where("Source is not null and Target is not null").select("Source", "Target")
    pairs.select(F.concat_ws(" ", "Source", "Target")).unionAll(spark.createDataFrame([("% a comment",)], "c string")).write.text(path)
    return src.read_friendships(spark, path)


def src_social_file(spark: SparkSession, d: str) -> DataFrame:
    """Written as a raw file of pairs and read back: constant Date, copies removed."""
    path = scratch(spark)
    load(spark, d, "youtube_growth").where("Source is not null and Target is not null").select(F.concat_ws(" ", "Source", "Target")).write.text(path)
    return src.read_social(spark, path, SEED)


def io_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Quality per day, written as result CSV in two parts, the second appended, and read back."""
    got = cut(eval_by_day(spark, d).where("day is not null").select(F.col("day").cast("string").alias("day"), "tp", "precision", "recall", "roc_auc", "accuracy", "f1_score"))
    path = scratch(spark)
    even = F.dayofmonth(F.col("day").cast("date")) % 2 == 0
    report.write_results(got.where(even), path)
    report.write_results(got.where(~even), path, resume=True)
    return report.read_results(spark, path, "day string, tp bigint, precision double, recall double, roc_auc double, accuracy double, f1_score double")


def io_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Degrees metrics of train, valid and test, written as one JSON object by split and read back."""
    parts = [graph.graph_info(g.call_numbers(spark, d, k)).select(F.lit(k).alias("split"), "*") for k in ("train", "valid", "test")]
    path = scratch(spark)
    report.write_metrics_json(report.union_all(parts), "split", path)
    return report.read_metrics_json(spark, path, {"nodes": "bigint", "edges": "bigint", "avg_in_degree": "double", "avg_out_degree": "double"})


def transpose_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Link statistics with a column per outcome and a row per statistic."""
    stats = link_stats(spark, d).select("Split", *[F.col(c).cast("double").alias(c) for c in ("Common", "Hub", "pct_common_0", "NUnique")])
    return report.transpose(stats, "Split").withColumnRenamed("key", "statistic").select("statistic", "TP", "TN", "FP", "FN", "POS", "NEG")


def sample_rw(spark: SparkSession, d: str) -> DataFrame:
    e = cut(g.growth(spark, d))
    return sample.sample_walk(e, _size(e, 0.05), SEED)


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(cut(g.call_numbers(spark, d, part)) for part in ("train", "test"))


def neg_train(spark: SparkSession, d: str) -> DataFrame:
    return g.as_text(sample.negative_train(*_frames(spark, d), SEED))


def neg_test(spark: SparkSession, d: str) -> DataFrame:
    tr, te = _frames(spark, d)
    return g.as_text(sample.negative_test(tr, te, cut(sample.negative_train(tr, te, SEED)), SEED))


def neg_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = sample.with_negatives(*_frames(spark, d), SEED)
    return g.as_text(a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test"))))


def neg_corrupt(spark: SparkSession, d: str) -> DataFrame:
    return g.as_text(sample.negative_corrupt(g.call_numbers(spark, d, "train"), SEED))


def gen_gnp(spark: SparkSession, d: str) -> DataFrame:
    """G(2000, 0.002), directed."""
    return generators.gnp_digraph(spark, 2000, 0.002)


def gen_random_dates(spark: SparkSession, d: str) -> DataFrame:
    """A hashed moment of July 2008 for every debug row."""
    at = moments.random_moment("2008-07-01", "2008-08-01", SEED, "row_id")
    return load(spark, d, "debug").select("row_id", at.alias("moment"))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return model.evaluate(load(spark, d, "debug"))


def eval_by_day(spark: SparkSession, d: str) -> DataFrame:
    return model.evaluate(load(spark, d, "debug").withColumn("day", F.col("Date").cast("date")), ["day"])


def link_stats(spark: SparkSession, d: str) -> DataFrame:
    return model.link_stats(load(spark, d, "debug").withColumn("Target", id_text("Target")))


def split_predictions(spark: SparkSession, d: str) -> DataFrame:
    return model.split_predictions(load(spark, d, "debug").select("row_id", "Class", "Predicted")).select("row_id", "Split")


def unpivot_degrees(spark: SparkSession, d: str) -> DataFrame:
    return report.unpivot(g.as_text(graph.degrees(g.call_numbers(spark, d))), "node", ["in_degree", "out_degree", "degree"])


def pivot_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcome counts per day, one column per outcome."""
    o = load(spark, d, "debug").select(F.col("Date").cast("date").alias("day"), model.outcome().alias("o")).where("o is not null")
    c = o.groupBy("day", "o").agg(F.count(F.lit(1)).alias("n"))
    return report.pivot(c, "day", "o", "n", ["TP", "TN", "FP", "FN"]).fillna(0)


QUERIES = {
    "src_edges_dedup": g.calls, "dedup_edges": dedup_edges, "src_edges_date_join": src_edges_date_join, "src_edges_social": src_edges_social,
    "src_edges_first_seen": g.growth, "src_by_day": src_by_day, "edges_per_month": edges_per_month, "distinct_nodes_profile": distinct_nodes_profile,
    "describe_debug": describe_debug, "time_split_calendar": time_split_calendar, "time_split_day": time_split_day, "prefix_split": prefix_split,
    "fraction_split": fraction_split, "capped_split": capped_split, "train_test_split": train_test_split, "filter_test": filter_test,
    "known_nodes": known_nodes, "top_targets": top_targets, "sample_time": sample_time, "sample_random": sample_random, "sample_node": sample_node,
    "sample_bfs_full": sample_bfs_full, "sample_dfs_full": sample_dfs_full, "src_friendships": src_friendships, "src_social_file": src_social_file,
    "io_csv_round_trip": io_csv_round_trip, "io_json_round_trip": io_json_round_trip, "transpose_outcomes": transpose_outcomes,
    "sample_bfs": sample_bfs, "sample_dfs": sample_dfs, "sample_rw": sample_rw, "neg_train": neg_train, "neg_test": neg_test, "neg_all": neg_all,
    "neg_corrupt": neg_corrupt, "gen_gnp": gen_gnp, "gen_random_dates": gen_random_dates, "eval_metrics": eval_metrics, "eval_by_day": eval_by_day,
    "link_stats": link_stats, "split_predictions": split_predictions, "unpivot_degrees": unpivot_degrees, "pivot_outcomes": pivot_outcomes,
}

_H = sql_key_hash(SEED, '"Source"', '"Target"')
_KS = '"Source", "Target"'


def _ranked(e: str, by: str) -> str:
    return f"r as (select *, row_number() over (order by {by}) rn, count(*) over () n from {e})"


def _traverse(desc: bool) -> str:
    o = "translate(at_, '0123456789', '9876543210')" if desc else "at_"
    return with_("yt", more=f"""nd as (select node, row_number() over (order by {sql_key_hash(SEED, 'node')}, node) rr from {sql_nodes('yt')}),
h1 as (select rr, 0 hop, node at_, "Source", "Target" from nd join yt on yt."Source" = node),
h2 as (select distinct h1.rr, 1 hop, h1."Target" at_, y."Source", y."Target" from h1 join yt y on y."Source" = h1."Target" where h1."Source" <> h1."Target"),
st as (select *, {o} o from (select * from h1 union all select * from h2) q),
f as (select "Source", "Target", min(row(rr, hop, o, at_)) step from st group by 1, 2),
p as (select step, count(*) k from f group by 1), c as (select step, k, sum(k) over (order by step) total from p),
s as (select step from c where total - k < (select cast(floor(count(*) * 0.1) as bigint) from yt))
select yt."Date", yt."Source", yt."Target", yt."Class" from yt join f using ("Source", "Target") where f.step in (select step from s)""")


def _draws(tag: str, of: str) -> str:
    pick = lambda side: f"{sql_hash_int(SEED, repr(tag + side), 'id')} % (select count(*) from ix)"
    return f"""(select distinct a.node "Source", b.node "Target" from (select distinct {pick('s')} si, {pick('t')} ti from range((select count(*) from {of})) r(id)) q
        join ix a on a.ix = si join ix b on b.ix = ti where si <> ti)"""


_IX = f"ix as (select node, row_number() over (order by node) - 1 ix from {sql_nodes('tr')})"
_NOT = lambda e, a="c": f'not exists (select 1 from {e} x where x."Source" = {a}."Source" and x."Target" = {a}."Target")'
_NEG = f"""{_IX}, nt as (select * from {_draws('', 'tr')} c where {_NOT('tr')} and {_NOT('tv')}),
    ns as (select * from {_draws('test-', 'tv')} c where {_NOT('tr')} and {_NOT('tv')} and {_NOT('nt')})"""
_NEGCOLS = 'cast(null as timestamp) "Date", "Source", "Target", 0 "Class"'
_EVAL = """tp, tn, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) as "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 4) recall,
    round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 4) roc_auc,
    round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 4) accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) f1_score"""
_COUNTS = """count(*) filter ("Class" = 1 and "Predicted" = 1) tp, count(*) filter ("Class" <> 1 and "Predicted" <> 1) tn,
    count(*) filter ("Class" <> 1 and "Predicted" = 1) fp, count(*) filter ("Class" = 1 and "Predicted" <> 1) fn"""
_OUT = """o as (select *, case when "Class" = 1 then case when "Predicted" = 1 then 'TP' else 'FN' end else case when "Predicted" = 1 then 'FP' else 'TN' end end o
    from debug where "Class" is not null and "Predicted" is not null)"""
_SP = f"""{_OUT}, sp as (select *, o as "Split" from o union all select *, case when "Predicted" = 1 then 'POS' else 'NEG' end from o)"""
_DESC = " union all ".join(
    f"""select '{c}' as "column", count("{c}") n, round(avg("{c}"), 6) mean, round(stddev_samp("{c}"), 6) std, cast(min("{c}") as double) min,
    round(quantile_cont("{c}", 0.25), 6) q25, round(quantile_cont("{c}", 0.5), 6) q50, round(quantile_cont("{c}", 0.75), 6) q75, cast(max("{c}") as double) max from debug"""
    for c in ("source_in", "source_out", "target_in", "target_out", "Hub", "Common")
)

_INFO = " union all ".join(
    f"""select '{k}' size, count(*) nodes, cast(sum(o) as bigint) edges, round(avg(i), 6) avg_in_degree, round(avg(o), 6) avg_out_degree from {sql_degrees(f'c_{k}')} q"""
    for k in ("train", "valid", "test")
)
_BY_SPLIT = ", ".join(
    f"""c_{k} as (select distinct {_S} "Source", {_T} "Target" from dynamobi where "Class" = 1 and split = '{k}' and {_S} is not null and {_T} is not null)""" for k in ("train", "valid", "test")
)

ORACLE = {
    "gen_gnp": f"""with d as (select s, j, least(floor(ln(({sql_hash_int(1, 's', 'j')} + 1) / {float((1 << 32) + 1)}::double) / ln(1 - 0.002::double)) + 1, 2000) gap from range(2000) a(s), range(60) b(j)),
        c as (select s, sum(gap) over (partition by s order by j) - 1 at_ from d)
        select 1 "Date", cast(s as varchar) "Source", cast(cast(at_ + case when at_ >= s then 1 else 0 end as bigint) as varchar) "Target", 1 "Class" from c where at_ < 1999""",
    "sample_rw": with_("yt", more=f"""ixd as materialized (select "Source" s, "Target" t, row_number() over (partition by "Source" order by "Target") - 1 ix, count(*) over (partition by "Source") k from yt),
        kd as materialized (select distinct s, k from ixd), sz as (select cast(floor(count(*) * 0.05) as bigint) z from yt),
        st as materialized (select s node, row_number() over (order by {sql_key_hash(SEED, 's')}, s) rn, count(*) over () n from kd),
        wk(walker, step, start_, at_, dead, f, t) as (select w, 0, node, node, 0, null::varchar, null::varchar from range(1, (select greatest(64, -(-z // 16)) from sz) + 1) r(w) join st on rn = (w - 1) % n + 1
        union all select walker, step + 1, case when renew then node else start_ end, case when renew then node else coalesce(t2, start_) end, case when d2 = 100 then 0 else d2 end, at_, t2 from (
            select q.*, st.node, (t2 is not null and u < 0.15) or d2 = 100 renew from (
                select walker, step, start_, at_, x.t t2, dead + case when x.t is null then 1 else 0 end d2, {sql_hash_int(SEED, 'walker', 'step', "'r'")} / 4294967296.0::double u, {sql_hash_int(SEED, 'walker', 'step', "'s'")} hs
                from wk left join kd on kd.s = at_ left join ixd x on x.s = at_ and x.ix = {sql_hash_int(SEED, 'walker', 'step')} % kd.k where step < 400) q
            join st on st.rn = hs % st.n + 1) z),
        met as (select f, t, min(row(step, walker)) o from wk where t is not null group by 1, 2), pick as (select f, t, row_number() over (order by o) rn from met)
        """) + """select yt.* from yt join pick on pick.f = "Source" and pick.t = "Target" where rn <= (select z from sz)""",
    "src_friendships": 'select cast(null as timestamp) "Date", "Source", "Target", 1 "Class" from youtube_growth where "Source" is not null and "Target" is not null',
    "src_social_file": 'select distinct 1 "Date", "Source", "Target", 1 "Class" from youtube_growth where "Source" is not null and "Target" is not null',
    "io_csv_round_trip": f"""select cast("day" as varchar) "day", tp, "precision", recall, roc_auc, accuracy, f1_score from (select "day", {_EVAL} from (select cast("Date" as date) as "day", {_COUNTS} from debug
        where "Class" is not null and "Predicted" is not null group by 1) q) z where "day" is not null""",
    "io_json_round_trip": f"with {_BY_SPLIT} {_INFO}",
    "transpose_outcomes": f"""with {_SP}, st as (select "Split", avg("Common") c, avg("Hub") h, 100.0 * avg(cast("Common" = 0 as int)) z, count(distinct {_T}) u from sp group by 1),
        lg as (select 'Common' statistic, "Split", round(c, 4) x from st union all select 'Hub', "Split", round(h, 4) from st union all select 'pct_common_0', "Split", round(z, 4) from st
        union all select 'NUnique', "Split", cast(u as double) from st)
        select statistic, {', '.join(f"""max(x) filter ("Split" = '{k}') "{k}" """ for k in ("TP", "TN", "FP", "FN", "POS", "NEG"))} from lg group by 1""",
    "src_edges_dedup": with_("calls") + "select * from calls",
    "dedup_edges": f"""select "Date", s "Source", t "Target", call_id, "Class", split, feed from (select *, row_number() over (partition by s, t order by "Date" nulls last, call_id) rn
        from (select *, {_S} s, {_T} t from dynamobi) q where s is not null and t is not null) w where rn = 1""",
    "src_edges_date_join": """select "Date", cast(try_cast(e."Source" as int) as varchar) "Source", cast("Target" as varchar) "Target", 1 "Class" from hepph_edges e
        join hepph_dates d on try_cast(d."Source" as int) = e."Source" """,
    "src_edges_social": f"""select 1 "Date", "Source", "Target", 1 "Class", row_number() over (order by {_H}, {_KS}) rn from (select distinct {_KS} from youtube_growth) q""",
    "src_edges_first_seen": with_("yt") + "select * from yt",
    "src_by_day": f"""select cast("Date" as date) as "day", count(distinct {_S} || '>' || {_T}) edges from dynamobi where "Class" = 1 and "Date" is not null group by 1""",
    "edges_per_month": with_("yt") + """select cast(year("Date") as int) as "year", cast(month("Date") as int) as "month", count(*) edges from yt group by 1, 2""",
    "distinct_nodes_profile": f"""select split, count(*) as "rows", count(distinct {_S}) sources, count(distinct {_T}) targets from dynamobi group by 1""",
    "describe_debug": _DESC,
    "time_split_calendar": with_("yt") + """select * from (select *, case when year("Date") = 2006 or month("Date") <= 3 then 'train'
        when year("Date") = 2007 and month("Date") > 3 then 'test' end part from yt) q where part is not null""",
    "time_split_day": with_("calls") + """select *, case when day("Date") = (select day(min("Date")) from calls) then 'train' else 'test' end part from calls where "Date" is not null""",
    "prefix_split": with_("yt", more=_ranked("yt", f'"Date" nulls last, {_KS}')) + """select "Date", "Source", "Target", "Class", case when rn <= floor(n * 0.25) then 'train' else 'test' end part from r""",
    "fraction_split": with_("calls", more=_ranked("calls", f"{_H}, {_KS}")) + """select "Date", "Source", "Target", "Class", case when rn <= floor(n * 0.25) then 'train' else 'test' end part from r""",
    "capped_split": with_("yt", more=_ranked("yt", f"{_H}, {_KS}")) + """select "Date", "Source", "Target", "Class", case when rn <= floor(n * 0.25) then 'train' else 'test' end part from r
        where rn <= floor(n * 0.25) + 500000""",
    "train_test_split": with_("yt", more=_ranked("yt", f'"Date" nulls last, {_KS}')) + f"""select "Date", "Source", "Target", "Class", part from
        (select *, case when rn <= floor(n * 0.75) then 'train' else 'test' end part from r) q where part = 'train' or
        ("Source" in (select node from {sql_nodes('(select * from r where rn <= floor(n * 0.75))')}) and "Target" in (select node from {sql_nodes('(select * from r where rn <= floor(n * 0.75))')}))""",
    "filter_test": with_("tr", "te", "trn", "ft") + "select * from ft",
    "known_nodes": with_("tr", "tv", "trn") + 'select "Source", "Target" from tv where "Source" in (select v from trn) and "Target" in (select v from trn)',
    "top_targets": with_("calls") + 'select "Target", count(*) edges from calls group by 1 order by 2 desc, 1 limit 10',
    "sample_time": with_("calls", more=_ranked("calls", f'"Date" nulls last, {_KS}')) + 'select "Date", "Source", "Target", "Class" from r where rn <= floor(n * 0.25)',
    "sample_random": with_("calls", more=_ranked("calls", f"{_H}, {_KS}")) + 'select "Date", "Source", "Target", "Class" from r where rn <= floor(n * 0.25)',
    "sample_node": with_("yt", more=f"""nd as (select node, (row_number() over (order by {sql_key_hash(SEED, 'node')}, node) - 1) // 100 b from {sql_nodes('yt')}),
        p as (select b, count("Target") k from nd left join yt on "Source" = node group by 1), c as (select b, k, sum(k) over (order by b) total from p)""")
    + """select * from yt where "Source" in (select node from nd join c using (b) where total - k < (select floor(count(*) * 0.1) from yt))""",
    "sample_bfs": _traverse(False),
    "sample_dfs": _traverse(True),
    "neg_train": with_("tr", "tv", more=_NEG) + f"select {_NEGCOLS} from nt",
    "neg_test": with_("tr", "tv", more=_NEG) + f"select {_NEGCOLS} from ns",
    "neg_all": with_("tr", "tv", more=_NEG) + f"""select "Date", "Source", "Target", "Class", 'train' part from tr union all select {_NEGCOLS}, 'train' from nt
        union all select "Date", "Source", "Target", "Class", 'test' from tv union all select {_NEGCOLS}, 'test' from ns""",
    "neg_corrupt": with_("tr", more=f"""{_IX}, c as (select distinct case when ks then "Source" else node end "Source", case when ks then node else "Target" end "Target" from
        (select "Source", "Target", {sql_hash_int(SEED, "'side'", '"Source"', '"Target"')} % 2 = 0 ks, {sql_hash_int(SEED, "'node'", '"Source"', '"Target"')} % (select count(*) from ix) ix from tr) q join ix using (ix))""")
    + f"""select {_NEGCOLS} from c where "Source" <> "Target" and {_NOT('tr')}""",
    "gen_random_dates": f"""select row_id, timestamp '2008-07-01' + to_seconds({sql_hash_int(SEED, 'row_id')} % {31 * 86400}) moment from debug""",
    "eval_metrics": f"select {_EVAL} from (select {_COUNTS} from debug) q",
    "eval_by_day": f"""select "day", {_EVAL} from (select cast("Date" as date) as "day", {_COUNTS} from debug where "Class" is not null and "Predicted" is not null group by 1) q""",
    "link_stats": f"""with {_SP} select "Split", round(avg("Common"), 4) "Common", round(avg("Hub"), 4) "Hub",
        round(100.0 * avg(cast("Common" = 0 as int)), 4) pct_common_0, count(distinct {_T}) "NUnique" from sp group by 1""",
    "split_predictions": f'with {_SP} select row_id, "Split" from sp',
    "unpivot_degrees": with_("calls", more=f"dg as (select * from {sql_degrees('calls')} q)") + """select node, 'in_degree' as "method", i as "value" from dg
        union all select node, 'out_degree', o from dg union all select node, 'degree', i + o from dg""",
    "pivot_outcomes": f"""with {_OUT} select cast("Date" as date) as "day", count(*) filter (o = 'TP') "TP", count(*) filter (o = 'TN') "TN",
        count(*) filter (o = 'FP') "FP", count(*) filter (o = 'FN') "FN" from o group by 1""",
}
