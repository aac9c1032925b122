"""Spark rows against DuckDB rows, without order."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(df):
    def one(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str(list(v))
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        return v.item() if hasattr(v, "item") else v

    df = df[sorted(df.columns)]
    return sorted((tuple(one(v) for v in r) for r in df.itertuples(index=False)), key=lambda r: tuple((x is None, float(x) if isinstance(x, (int, float)) else 0.0, str(x)) for x in r))


def same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert plain(a) == plain(b)
    return len(a)
