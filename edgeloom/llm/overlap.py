"""Rows of evaluation splits that repeat a training row, exactly or almost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.ids import id_number, sql_id_number
from edgeloom.session import cut, cut_counted
from edgeloom.sources.tables import load

TRAIN, EVAL = 1, 2


def one_edit(a: str, b: str) -> Column:
    """Whether two strings of equal length differ by one replaced character or two neighbouring ones exchanged."""
    diff = f"filter(sequence(1, length({a})), i -> substr({a}, i, 1) <> substr({b}, i, 1))"
    i, j = f"get({diff}, 0)", f"get({diff}, 1)"
    swap = f"""size({diff}) = 2 and {j} = {i} + 1 and substr({a}, {i}, 1) = substr({b}, {j}, 1)
        and substr({a}, {j}, 1) = substr({b}, {i}, 1)"""
    return F.expr(f"length({a}) = length({b}) and (size({diff}) = 1 or ({swap}))")


OVERSIZED = 10_000  # records of a block beyond which it is cut finer

_SIDES = (("s", "s", "t"), ("t", "t", "s"))  # kind, the field taken whole, the field that may differ


def _block_hashes() -> Column:
    """Four hashes per record: one field whole, and the other without its last or without its first half and middle.

    One replaced digit, or two exchanged neighbours, leave the digits before the middle one or those after it as they
    were; so two records that differ in this way in one field share a hash, and few others do.
    """
    out = []
    for kind, whole, part in _SIDES:
        txt = F.col(part).cast("string")
        n = F.length(txt)
        half = F.floor((n - 1) / 2).cast("int")
        out.append(F.xxhash64(F.lit(f"{kind}<"), F.col(whole), n, txt.substr(F.lit(1), half)))
        out.append(F.xxhash64(F.lit(f"{kind}>"), F.col(whole), n, txt.substr(n - half + 1, half)))
    return F.array(*out)


def _fine_hashes(h: str) -> Column:
    """Of a block: a hash per digit left out and per pair of neighbours taken without their order.

    Two records one edit apart share one of them; at most ten records share a hash of the first kind, two of the second.
    """
    x = f"cast(if({h}_kind = 's', t, s) as string)"
    out = f"transform(sequence(1, length({x})), i -> xxhash64({h}, i, left({x}, i - 1), substr({x}, i + 1)))"
    a, b = f"substr({x}, i, 1)", f"substr({x}, i + 1, 1)"
    swap = f"transform(sequence(1, length({x}) - 1), i -> xxhash64({h}, -i, left({x}, i - 1), least({a}, {b}), greatest({a}, {b}), substr({x}, i + 2)))"
    return F.expr(f"if(length({x}) > 1, concat({out}, {swap}), {out})")


def _blocks(distinct: DataFrame, oversized: int) -> DataFrame:
    """(s, t, f, h): the block hashes of each record; records of an oversized block have its fine hashes instead.

    A block lies within the records of one value of its whole field, so only values with more than ``oversized`` records
    are looked at: mostly none or a few.
    """
    every = distinct.select("s", "t", "f", F.posexplode(_block_hashes()).alias("p", "h"))
    kind = F.when(F.col("p") < 2, "s").otherwise("t")
    big = [distinct.groupBy(F.lit(k).alias("k"), F.col(w).alias("v")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > oversized) for k, w, _ in _SIDES]
    big, (found,) = cut_counted(big[0].unionByName(big[1]).select("k", "v"))
    if not found:
        return every.select("s", "t", "f", "h")
    mine = [
        distinct.join(big.where(F.col("k") == k).select(F.col("v").alias(w)), w, "left_semi").select(F.explode(F.slice(_block_hashes(), at, 2)).alias("h"))
        for (k, w, _), at in zip(_SIDES, (1, 3), strict=True)
    ]
    many = mine[0].unionByName(mine[1]).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > oversized)
    many, (found,) = cut_counted(many.select("h"))
    if not found:
        return every.select("s", "t", "f", "h")
    fine = every.join(many, "h", "left_semi").withColumn("h_kind", kind).select("s", "t", "f", F.explode(_fine_hashes("h")).alias("h"))
    return every.join(many, "h", "left_anti").select("s", "t", "f", "h").unionByName(fine)


def canonical_records(df: DataFrame, row_id: str, fields: Sequence[str], split: str, train: str, evals: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(id, s, t, f, keep...): canonical numbers of both fields, f = 1 train, 2 evaluation.

    Rows of another split are left out. Written once: each later step reads numbers instead of parsing the ids again.
    """
    f = F.when(F.col(split) == train, TRAIN).when(F.col(split).isin(*evals), EVAL)
    s, t = (id_number(c) for c in fields)
    out = df.select(F.col(row_id).alias("id"), s.alias("s"), t.alias("t"), f.alias("f"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    return cut(out.where("f is not null"))


def _usable(rows: DataFrame) -> DataFrame:
    """Rows without an id, or with a field that has no number, cannot repeat anything."""
    return rows.where("id is not null and s is not null and t is not null")


def record_links(rows: DataFrame, oversized: int = OVERSIZED) -> DataFrame:
    """(s1, t1, s2, t2, near): each train record with each evaluation record equal to it or one edit away.

    Works on distinct records, so copies cost nothing; equal records meet by grouping, near ones by joining block
    hashes of evaluation records with those of training records and verifying every candidate.
    """
    distinct = cut(rows.groupBy("s", "t").agg(F.bit_or("f").alias("f")))
    exact = distinct.where(f"f = {TRAIN | EVAL}").selectExpr("s s1", "t t1", "s s2", "t t2", "false near")
    blocks = _blocks(distinct, oversized)
    a = blocks.where(f"f & {TRAIN} <> 0").selectExpr("h", "s s1", "t t1")
    b = blocks.where(f"f & {EVAL} <> 0").selectExpr("h h2", "s s2", "t t2")
    cand = a.join(b, F.expr("h = h2 and (s1 = s2) <> (t1 = t2)")).select("s1", "t1", "s2", "t2")
    cand = cand.selectExpr("*", "cast(if(s1 = s2, t1, s1) as string) x", "cast(if(s1 = s2, t2, s2) as string) y")
    near = cand.where(one_edit("x", "y")).select("s1", "t1", "s2", "t2").distinct()
    return exact.unionByName(near.withColumn("near", F.lit(True)))


def overlap_pairs(df: DataFrame, row_id: str, fields: Sequence[str], split: str, train: str = "train", evals: Sequence[str] = ("valid", "test"), oversized: int = OVERSIZED) -> DataFrame:
    """(id_train, id_eval, near): every overlapping pair of rows across splits. Empty input gives no rows.

    Rows without an id, of another split, or with a field that has no number repeat nothing.
    """
    rows = _usable(canonical_records(df, row_id, fields, split, train, evals))
    links = record_links(rows, oversized)
    a = rows.where(f"f = {TRAIN}").selectExpr("id id_train", "s s1", "t t1")
    b = rows.where(f"f = {EVAL}").selectExpr("id id_eval", "s s2", "t t2")
    return links.join(b, ["s2", "t2"]).join(a, ["s1", "t1"]).select("id_train", "id_eval", "near")


def overlap_counts(df: DataFrame, row_id: str, fields: Sequence[str], split: str, by: Sequence[str], train: str = "train", evals: Sequence[str] = ("valid", "test"), oversized: int = OVERSIZED) -> DataFrame:
    """(by..., eval_rows, rows_exact, rows_near, pairs_exact, pairs_near) per group of evaluation rows.

    The pairs are not formed: each record knows how many train rows it has and what it is linked to, and its evaluation rows
    enter as counts per group.
    """
    every = canonical_records(df, row_id, fields, split, train, evals, by)
    keys = [f"keep_{c}" for c in by]
    rows = _usable(every)
    copies = rows.where(f"f = {TRAIN}").groupBy(F.col("s").alias("s1"), F.col("t").alias("t1")).agg(F.count(F.lit(1)).alias("n"))
    per = record_links(rows, oversized).join(copies, ["s1", "t1"]).groupBy("s2", "t2").agg(
        F.sum(F.when(F.col("near"), 0).otherwise(F.col("n"))).alias("exact"), F.sum(F.when(F.col("near"), F.col("n")).otherwise(0)).alias("near")
    )
    usable = F.col("id").isNotNull() & F.col("s").isNotNull() & F.col("t").isNotNull()
    ev = every.where(f"f = {EVAL}").select(*keys, F.when(usable, F.col("s")).alias("s2"), F.when(usable, F.col("t")).alias("t2"))
    ev = ev.groupBy(*keys, "s2", "t2").agg(F.count(F.lit(1)).alias("m"))
    j = ev.join(per, ["s2", "t2"], "left").fillna(0, ["exact", "near"])
    m = F.col("m")
    return j.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)]).agg(
        F.sum(m).alias("eval_rows"), F.sum(F.when(F.col("exact") > 0, m).otherwise(0)).alias("rows_exact"), F.sum(F.when(F.col("near") > 0, m).otherwise(0)).alias("rows_near"),
        F.sum(m * F.col("exact")).alias("pairs_exact"), F.sum(m * F.col("near")).alias("pairs_near"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap_pairs(load(spark, d, "dynamobi"), "call_id", ("Source", "Target"), "split")
    return pairs.select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and feed: evaluation rows, how many repeat a train row exactly or almost, and the pairs of each kind."""
    return overlap_counts(load(spark, d, "dynamobi"), "call_id", ("Source", "Target"), "split", ("split", "feed"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

_S, _T = (sql_id_number(f'"{c}"') for c in ("Source", "Target"))
_PAIRS = f"""r as (select call_id, split, feed, cast({_S} as varchar) s, cast({_T} as varchar) t from dynamobi),
p as (select distinct s, t from r where s is not null and t is not null),
ed as (select a.s s1, a.t t1, b.s s2, b.t t2, a.t <> b.t or a.s <> b.s near from p a join p b on a.s = b.s
    where length(a.t) = length(b.t) and damerau_levenshtein(a.t, b.t) <= 1
  union select a.s, a.t, b.s, b.t, true from p a join p b on a.t = b.t and left(a.s, 4) = left(b.s, 4) where a.s <> b.s and length(a.s) = length(b.s) and damerau_levenshtein(a.s, b.s) = 1
  union select a.s, a.t, b.s, b.t, true from p a join p b on a.t = b.t and right(a.s, 4) = right(b.s, 4) where a.s <> b.s and length(a.s) = length(b.s) and damerau_levenshtein(a.s, b.s) = 1),
w as (select a.call_id ta, b.call_id tb, b.split split, b.feed feed, near from ed join r a on a.s = s1 and a.t = t1 and a.split = 'train'
    join r b on b.s = s2 and b.t = t2 and b.split in ('valid', 'test'))"""
ORACLE = {
    "p1_found": f"with {_PAIRS} select least(ta, tb) id_a, greatest(ta, tb) id_b from w",
    "p1_report": f"""with {_PAIRS}, k as (select tb, count(*) filter (not near) ex, count(*) filter (near) ne from w group by 1)
select split, feed, count(*) eval_rows, count(*) filter (ex > 0) rows_exact, count(*) filter (ne > 0) rows_near,
    cast(coalesce(sum(ex), 0) as bigint) pairs_exact, cast(coalesce(sum(ne), 0) as bigint) pairs_near
from r left join k on k.tb = r.call_id where split in ('valid', 'test') group by 1, 2""",
}
