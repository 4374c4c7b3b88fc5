"""Compares a query's rows with those of its SQL."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{source}')")
    return con


def value(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v if isinstance(v, str) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(value(v) for v in r) for r in frame.itertuples(index=False))


def assert_same(spark, con, name, query, sql, folder):
    mine, theirs = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns), name
    assert rows(mine) == rows(theirs), name
