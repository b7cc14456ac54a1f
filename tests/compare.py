"""Rows of Spark and DuckDB in one comparable form."""

from __future__ import annotations

import decimal
import os

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def connect(folder: str = SMALL):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(df: pd.DataFrame) -> tuple[list, list]:
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=repr)
