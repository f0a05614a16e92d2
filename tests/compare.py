"""Run a query in both engines and compare the rows."""

import pandas as pd


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for f in sf.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def _norm(df):
    def cell(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "null"
        if isinstance(x, float):
            return repr(x)
        s = str(x)
        return s[:10] if s.endswith(" 00:00:00") else s

    out = df[sorted(df.columns)].map(cell).astype(str)
    return sorted(map(tuple, out.to_numpy().tolist()))


def assert_same(spark_df, duck_df):
    a = spark_df.toPandas()
    assert sorted(a.columns) == sorted(duck_df.columns)
    for c in a.columns:
        if pd.api.types.is_float_dtype(a[c]) or pd.api.types.is_float_dtype(duck_df[c]):
            a[c], duck_df[c] = a[c].astype(float), duck_df[c].astype(float)
    assert _norm(a) == _norm(duck_df)
