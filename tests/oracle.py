"""Comparing a query with its SQL on the same Parquet tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(value) -> str:
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NaT or value is pd.NA or value != value:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(frame: pd.DataFrame) -> Counter:
    columns = sorted(frame.columns)
    return Counter(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False))
