import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgeloom.functions.hashing import hash_int
from edgeloom.functions.ids import amount, id_number, sql_amount, sql_id_number

N = "104159298627321"
WAYS = [
    N, f" {N} ", f"00{N}", f"+{N}", f"tel:{N}", f"'{N}", f'"{N}"', f"{N}.0", f"{N}.00", f"000{N}.00", "104.159.298.627.321", "104,159,298,627,321",
    "104-1592-9862-7321", "(1041) 59298627321", "10415 92986 27321", "10415 92986 27321", "10415929​8627321", "".join(chr(0xFF10 + int(c)) for c in N),
]


def test_id_is_one_number_however_written(spark):
    import duckdb

    df = spark.createDataFrame([(w,) for w in WAYS], "id string").select(id_number("id").alias("n"))
    assert {r.n for r in df.collect()} == {int(N)}
    con = duckdb.connect()
    for w in WAYS:
        assert con.execute(f"select {sql_id_number('x')} from (select ? x) q", [w]).fetchone()[0] == int(N)


def test_id_without_number_is_null(spark):
    bad = [None, "", "  ", "abc", "0", "000", "-", "1" * 19]
    df = spark.createDataFrame([(w,) for w in bad], "id string").select(id_number("id").alias("n"))
    assert {r.n for r in df.collect()} == {None}
    df = spark.createDataFrame([("7",), ("9" * 18,)], "id string").select(id_number("id").alias("n"))
    assert sorted(r.n for r in df.collect()) == [7, int("9" * 18)]


@pytest.mark.parametrize(("text", "value"), [("12", 12.0), (" 12 ", 12.0), ("76.0", 76.0), ("010", 10.0), ("", None), ("NA", None), ("\\N", None), (None, None), ("NaN", None), ("inf", None), ("1e3", None), ("5.", 5.0), ("-2", -2.0)])
def test_amount(spark, text, value):
    import duckdb

    assert spark.createDataFrame([(text,)], "a string").select(amount("a")).first()[0] == value
    assert duckdb.execute(f"select {sql_amount('x')} from (select cast(? as varchar) x) q", [text]).fetchone()[0] == value


@settings(max_examples=5, deadline=None)
@given(st.text(min_size=1, max_size=20))
def test_hash_int_is_md5(spark, s):
    got = spark.createDataFrame([(s,)], "k string").select(hash_int(42, F.col("k"))).first()[0]
    assert got == int(hashlib.md5(f"42|{s}".encode()).hexdigest()[:8], 16)
