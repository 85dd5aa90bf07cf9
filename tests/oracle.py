"""Run a registered query and its SQL side by side and compare them as multisets of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql: str, sf: str) -> str | None:
    """None when both agree, else what differs."""
    frame = run(spark, sf)
    got = rows_of(frame.columns, frame.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns: {sorted(frame.columns)} against {sorted(columns)}"
    want = rows_of(columns, result.fetchall())
    if got == want:
        return None
    extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
    return f"rows: {sum(got.values())} against {sum(want.values())}; only ours {extra}; only theirs {missing}"
