import datetime as dt
import random

import pytest
from conftest import rows

from edgeloom.operators import rolling


def _calls(spark, data):
    return spark.createDataFrame(data, "who bigint, Date timestamp_ntz, calls double, sec double, to string")


def _trees(df, measures=("calls", "sec"), content=None):
    return rolling.tree_rows(rolling.daily_leaves(df, "who", "Date", measures, content), "who", measures)


def _brute(data, windows):
    dated = [r for r in data if r[1] is not None]
    lo, hi = min(r[1].date() for r in dated), max(r[1].date() for r in dated)
    out = {}
    for w in {r[0] for r in data if r[0] is not None}:
        day = lo
        while day <= hi:
            res = []
            for k in windows:
                got = [r for r in dated if r[0] == w and day - dt.timedelta(k - 1) <= r[1].date() <= day]
                res.append((len(got), sum(r[2] or 0 for r in got), sum(r[3] or 0 for r in got)))
            out[w, day] = res
            day += dt.timedelta(1)
    return out


@pytest.mark.parametrize("span", [1, 40, 200])
def test_against_brute_force(spark, span):
    rng = random.Random(span)
    t0 = dt.datetime(2008, 6, 20, 12)
    data = [(rng.choice([1, 2, 2, 2, 3]), t0 + dt.timedelta(days=rng.randrange(span)), rng.choice([None, 1.0, 4.0]), float(rng.randrange(100)), "t") for _ in range(120)]
    data += [(9, None, 1.0, 1.0, "t"), (None, t0, 1.0, 1.0, "t"), (4, t0, None, None, "t")]
    got = rolling.trailing(_trees(_calls(spark, data)), "who", ["calls", "sec"], (7, 30)).collect()
    want = _brute(data, (7, 30))
    assert len(got) == len(want)
    lo = min(r["day"] for r in got)
    for r in got:
        for k, (n, c, s) in zip((7, 30), want[r["who"], r["day"]], strict=True):
            assert (r[f"n_rows_{k}"], r[f"calls_sum_{k}"], r[f"sec_sum_{k}"]) == (n, c, s)
            assert r[f"calls_day_avg_{k}"] == c / min(k, (r["day"] - lo).days + 1)


def test_copies_and_empty(spark):
    t = dt.datetime(2008, 7, 1)
    df = _calls(spark, [(1, t, 2.0, 3.0, "x"), (1, t, 2.0, 3.0, "x"), (1, t, 2.0, 3.0, "y"), (1, t, None, 3.0, "y")])
    assert rows(rolling.daily_leaves(df, "who", "Date", ["calls", "sec"], ["to", "Date", "calls", "sec"]), "n_rows", "calls_sum", "calls_n") == [(3, 4.0, 2)]
    for none in (_calls(spark, []), _calls(spark, [(1, None, 1.0, 1.0, "x")])):
        assert rolling.trailing(_trees(none), "who", ["calls", "sec"]).count() == 0
        assert rolling.tree_nodes(_trees(none), "who").count() == 0
    with pytest.raises(ValueError, match="windows"):
        rolling.trailing(_trees(none), "who", ["calls"], (400,))


def test_one_wild_date_adds_one_day(spark):
    t = dt.datetime(2008, 7, 1)
    data = [(1, t, 2.0, 3.0, "x"), (2, t + dt.timedelta(3), 1.0, 1.0, "x"), (1, dt.datetime(9999, 12, 31), 5.0, 1.0, "x")]
    got = {(r.who, str(r.day)): (r.calls_sum_7, r.calls_day_avg_7) for r in rolling.trailing(_trees(_calls(spark, data)), "who", ["calls", "sec"]).collect()}
    assert len(got) == 2 * 5 and got[1, "9999-12-31"] == (5.0, 5.0) and got[2, "9999-12-31"] == (0.0, 0.0) and got[1, "2008-07-04"] == (2.0, 0.5)


def test_stored_leaves_are_the_leaves_of_the_answers(spark):
    """Re-deliveries count once in the stored trees as in the trailing totals."""
    rng = random.Random(8)
    t0 = dt.datetime(2008, 8, 1)
    data = [(rng.randrange(5), t0 + dt.timedelta(days=rng.randrange(90)), float(rng.randrange(3)), 1.0, rng.choice("xy")) for _ in range(400)]
    trees = _trees(_calls(spark, data + data[::3]), content=["to", "Date", "calls", "sec"])
    leaves = rolling.tree_nodes(trees, "who").where("level = 0").selectExpr("who", "date_add(date'1970-01-01', shard * 64 + pos) day", "n_rows", "calls_sum")
    day = rolling.trailing(trees, "who", ["calls", "sec"], (1,)).where("n_rows_1 > 0").select("who", "day", "n_rows_1", "calls_sum_1")
    assert rows(leaves) == rows(day)
    assert sum(r.n_rows for r in leaves.collect()) == len(set(data))


def test_tiles_are_few_and_exact():
    for lo in range(0, 130, 7):
        for hi in range(lo, 190, 3):
            tiles = rolling.canonical(lo, hi)
            days = [d for lv, ix in tiles for d in range(ix << lv, (ix + 1) << lv)]
            assert days == list(range(lo, hi + 1))
            assert all((ix << lv) // 64 == (((ix + 1) << lv) - 1) // 64 for lv, ix in tiles)


def test_correction_touches_only_ancestors(spark):
    t = dt.datetime(2008, 7, 1)
    base = _calls(spark, [(w, t + dt.timedelta(days=i), 1.0, 1.0, "x") for w in (1, 2) for i in range(60)] + [(3, None, 1.0, 1.0, "x")])
    late = _calls(spark, [(1, t + dt.timedelta(days=5), 10.0, 1.0, "x")])
    flat = lambda trees: rolling.tree_nodes(trees, "who")
    before, after = _trees(base), rolling.apply_corrections(_trees(base), _trees(late), "who")
    assert flat(after).exceptAll(flat(before)).count() == rolling.LEVELS + 1
    assert rows(after) == rows(_trees(base.unionAll(late)))


def test_store_rewrites_only_the_parts_of_a_correction(spark, tmp_path):
    t = dt.datetime(2008, 7, 1)
    ms = ["calls", "sec"]
    base = _calls(spark, [(w, t + dt.timedelta(days=i), 1.0, 1.0, "x") for w in range(40) for i in range(0, 60, 7)] + [(77, None, 1.0, 1.0, "x")])
    late = _calls(spark, [(5, t + dt.timedelta(days=5), 10.0, 1.0, "x"), (500, t, 1.0, None, "x"), (78, None, 1.0, 1.0, "x")])
    path = str(tmp_path / "store")
    rolling.store_trees(_trees(base), path, "who")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert rolling.correct_store(spark, path, _trees(late), "who", ms) == 3
    kept = [p for p in files if p.exists()]
    assert len(files) > 20 and len(kept) >= len(files) - 3 and all(p.stat().st_mtime_ns == files[p] for p in kept)
    assert rows(rolling.stored_trees(spark, path, "who", ms)) == rows(_trees(base.unionAll(late)))
    assert rolling.correct_store(spark, path, _trees(late.where("false")), "who", ms) == 0


def test_late_copy_is_no_correction(spark):
    t = dt.datetime(2008, 7, 1)
    df = spark.createDataFrame(
        [(1, t, 2.0, t, "x"), (1, t, 2.0, t + dt.timedelta(9), "x"), (1, t, 2.0, t + dt.timedelta(9), "y"), (1, None, None, None, "x"), (None, t, 1.0, t, "x")],
        "who bigint, Date timestamp_ntz, calls double, at timestamp_ntz, to string",
    )
    got = rolling.first_deliveries(df, "who", "Date", ["calls"], ["to", "Date", "calls"], "at")
    assert rows(got) == sorted([(1, t, 2.0, t), (1, t, 2.0, t + dt.timedelta(9)), (1, None, None, None)], key=repr)
