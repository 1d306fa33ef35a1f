"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def duck(data: str):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (list, np.ndarray)):
        return tuple(_value(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer, float, np.floating)):
        return round(float(v), 5)
    return str(v)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(_value(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def same(spark, data, query, sql) -> None:
    got, want = query(spark, data).toPandas(), duck(data).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
