"""Comparison of a DataFrame with DuckDB's rows for the oracle SQL."""

from __future__ import annotations

import datetime as dt
import os
from collections import Counter
from decimal import Decimal

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return f"{value:.10g}"
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, Decimal):
        return f"{float(value):.10g}"
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value if value is None or isinstance(value, bool) else str(value)


def rows(names, found) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in found)


def same(df, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
