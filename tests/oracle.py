"""Local stand-in for the driver's correctness gate: run a registered Spark
query and its DuckDB SQL on the same parquet tables and compare row count,
column names and the order-insensitive multiset of rows."""
from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pandas as pd

from fairgauge.session import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    con.execute("SET TimeZone='UTC'")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else round(v, 6)      # a nullable integer column may come as floats
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df, duck_df: pd.DataFrame) -> tuple[bool, str]:
    sp = spark_df.toPandas()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(duck_df)
    if c1 != c2:
        return False, f"columns differ: spark={c1} duck={c2}"
    if len(r1) != len(r2):
        return False, f"row count spark={len(r1)} duck={len(r2)}"
    for a, b in zip(r1, r2):
        if a != b:
            return False, f"first differing row: spark={a} duck={b}"
    return True, f"{len(r1)} rows"
