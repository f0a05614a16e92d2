import random
from collections import Counter
from math import sqrt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from edgeloom.llm import distinct, frequent, overlap


def _one_edit(a, b):
    if len(a) != len(b):
        return False
    d = [i for i in range(len(a)) if a[i] != b[i]]
    return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])


def _edit(rng, s):
    i = rng.randrange(1, len(s) - 1)
    if rng.random() < 0.5:
        return s[:i] + str((int(s[i]) + rng.randrange(1, 10)) % 10) + s[i + 1 :]
    return s[:i] + s[i + 1] + s[i] + s[i + 2 :]


@pytest.mark.parametrize(("width", "oversized"), [(15, overlap.OVERSIZED), (4, overlap.OVERSIZED), (15, 2), (4, 1), (1, 1)])
def test_overlap_against_brute_force(spark, width, oversized):
    rng = random.Random(width)
    ids = [str(rng.randrange(max(1, 10 ** (width - 1)), 10**width)) for _ in range(12)]
    data = []
    for i in range(260):
        s, t = rng.choice(ids), rng.choice(ids)
        if width > 1 and rng.random() < 0.3:
            s = _edit(rng, s)
        elif width > 1 and rng.random() < 0.3:
            t = _edit(rng, t)
        data.append((i, rng.choice([s, f" {s}", f"+{s}", f"{s}.0"]), t, rng.choice(["train", "valid", "test", None]), s, t))
    data += [(None, ids[0], ids[0], "test", "-", "-"), (999, None, ids[0], "test", "-", "-"), (998, "abc", ids[0], "train", "-", "-")]
    df = spark.createDataFrame([(*r[:4], 1, "x") for r in data], "call_id long, Source string, Target string, split string, s int, h string")
    got = rows(overlap.overlap_pairs(df, "call_id", ("Source", "Target"), "split", oversized=oversized))
    want = []
    for a in data[:-3]:
        for b in data[:-3]:
            if a[3] == "train" and b[3] in ("valid", "test"):
                same = (a[4] == b[4]) + (a[5] == b[5])
                if same == 2 or (same == 1 and (_one_edit(a[4], b[4]) or _one_edit(a[5], b[5]))):
                    want.append((a[0], b[0], same == 1))
    assert got == sorted(want, key=repr)
    assert any(n for *_, n in want)
    split_of = {r[0]: r[3] for r in data}
    n = {r.split: r for r in overlap.overlap_counts(df, "call_id", ("Source", "Target"), "split", ["split"], oversized=oversized).collect()}
    for k in ("valid", "test"):
        mine = [w for w in want if split_of[w[1]] == k]
        assert n[k].eval_rows == sum(r[3] == k for r in data)
        assert (n[k].pairs_exact, n[k].pairs_near) == (sum(not w[2] for w in mine), sum(w[2] for w in mine))
        assert (n[k].rows_exact, n[k].rows_near) == (len({w[1] for w in mine if not w[2]}), len({w[1] for w in mine if w[2]}))


def test_overlap_empty_and_hot(spark):
    schema = "call_id long, Source string, Target string, split string"
    assert overlap.overlap_pairs(spark.createDataFrame([], schema), "call_id", ("Source", "Target"), "split").count() == 0
    hot = [(i, "123456789012345", "223456789012345", "train" if i else "test") for i in range(300)]
    assert overlap.overlap_pairs(spark.createDataFrame(hot, schema), "call_id", ("Source", "Target"), "split").count() == 299


def test_frequent_against_counter(spark):
    rng = random.Random(1)
    v = [int(rng.paretovariate(0.8)) for _ in range(4000)] + [None] * 100 + [7] * 2000
    df = spark.createDataFrame([(x, -x if x else None, "clash") for x in v], "v long, w long, n string").repartition(5)
    fields = {"v": F.col("v"), "w": F.col("w")}
    c = Counter(x for x in v if x is not None)
    top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:20]
    got = frequent.most_frequent(df, fields, 20).where("field = 'v'").orderBy("rank").collect()
    assert [(r.value, r.n) for r in got] == top
    heavy = rows(frequent.frequent_share(df, fields, 0.02))
    assert heavy == sorted([(f, s * k, n) for f, s in (("v", 1), ("w", -1)) for k, n in c.items() if n >= 0.02 * len(v)], key=repr)
    assert frequent.frequent_share(df.where("false"), fields, 0.1).count() == 0
    assert frequent.frequent_share(df.where("v is null"), fields, 0.1).count() == 0


def test_bounded_runs_and_heap(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(frequent, "RUN_ROWS", 10)
    b = [pa.RecordBatch.from_arrays([pa.array([1, 2, 2, None, 3] * 3, pa.int64())], ["v"]) for _ in range(4)]
    runs = list(frequent._sorted_runs(iter(b), 1))
    assert max(r.num_rows for r in runs) <= 10 and sum(sum(r.column("n").to_pylist()) for r in runs) == 48
    v = np.sort(np.r_[np.arange(100), np.arange(100), [50] * 5])
    part = [pa.RecordBatch.from_arrays([pa.array(np.zeros(k.size, np.int32)), pa.array(k), pa.array(np.ones(k.size, np.int64))], ["field", "value", "n"]) for k in np.array_split(v, 9)]
    (out,) = frequent._merge_runs(iter(part), 3)
    assert sorted(zip(out.column("value").to_pylist(), out.column("n").to_pylist(), strict=True)) == [(0, 2), (1, 2), (50, 7)]


def test_distinct_within_error_and_mergeable(spark):
    df = spark.range(40_000).select((F.col("id") % 9000).alias("a"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 > 0, "b").alias("g"), (F.col("id") % 4).alias("h"))
    dims, items = {"g": F.col("g"), "h": F.col("h")}, {"a": F.col("a")}
    parts = distinct.sketches(df.where("id < 20000"), dims, items).unionByName(distinct.sketches(df.where("id >= 20000"), dims, items))
    got = {(r.grouping, r.g, r.h): r for r in distinct.merge_all_groups(parts, ["g", "h"], ["a"]).collect()}
    whole = {(r.grouping, r.g, r.h): r.distinct_a for r in distinct.merge_all_groups(distinct.sketches(df, dims, items), ["g", "h"], ["a"]).collect()}
    exact = {("g,h", r.g, r.h): r.n for r in df.groupBy("g", "h").agg(F.countDistinct("a").alias("n")).collect()}
    exact |= {("g", r.g, None): r.n for r in df.groupBy("g").agg(F.countDistinct("a").alias("n")).collect()} | {("", None, None): 9000}
    exact |= {("h", None, r.h): r.n for r in df.groupBy("h").agg(F.countDistinct("a").alias("n")).collect()}
    assert set(got) == set(exact) == set(whole)
    for k, n in exact.items():
        assert abs(got[k].distinct_a - n) <= max(2, 4 * distinct.standard_error() * n)
        assert abs(got[k].distinct_a - whole[k]) <= max(2, 4 * distinct.standard_error() * n)
    assert got["", None, None].n_rows == 40_000 and got["", None, None].standard_error == 1.04 / sqrt(4096)


def test_distinct_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x")], "a long, g string")
    p = distinct.sketches(df, {"g": F.col("g")}, {"a": F.col("a")})
    r = distinct.merge_all_groups(p, ["g"], ["a"]).where("grouping = 'g'").first()
    assert (r.n_rows, r.distinct_a) == (2, 0)
    assert distinct.merge_all_groups(distinct.sketches(df.where("false"), {"g": F.col("g")}, {"a": F.col("a")}), ["g"], ["a"]).count() == 0


def test_registers_merge_by_maximum(spark):
    df = spark.range(30_000)
    regs = lambda d: distinct.registers(d, {"k": F.lit(1)}, {"id": F.col("id")})
    a, b = regs(df.where("id < 20000")), regs(df.where("id >= 10000"))
    merged = a.unionByName(b).groupBy("k", "item", "register").agg(F.max("rank").alias("rank"))
    assert rows(merged) == rows(regs(df))
    est = distinct.register_estimates(merged, ["k"]).first().estimate
    assert abs(est - 30_000) < 4 * distinct.standard_error() * 30_000
