"""Rows in a form that both engines' results share."""

import math
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(x):
    if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return f"{x + 0.0:.6g}"
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(x) for x in r) for r in frame.astype(object).itertuples(index=False))
