"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = glob.glob(f"{path}/*.parquet") or [path]
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet({files})")
    return con


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    if hasattr(v, "item"):
        v = v.item()
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(map(_value, row)) for row in df[columns].astype(object).itertuples(index=False))


def assert_same(spark_df, con, sql: str) -> None:
    found, wanted = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    numeric = [c for c in wanted.columns if pd.api.types.is_float_dtype(wanted[c]) or pd.api.types.is_float_dtype(found[c])]
    for df in (found, wanted):
        for c in numeric:
            df[c] = df[c].astype(float)
    assert rows(found) == rows(wanted)
