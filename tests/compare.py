"""Rows of a query and of its SQL in a comparable form."""

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def _cell(v):
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(_cell, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (int, np.integer)):
        return f"{float(v):.6g}" if abs(int(v)) < 10**6 else str(int(v))
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(v).tz_localize(None))
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(_cell(v) for v in r) for r in frame.itertuples(index=False))
