"""Runs a registered query and its SQL and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7) + 0.0
    if isinstance(v, list):
        return tuple(map(_plain, v))
    return v


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str, d: str) -> str:
    """Empty if the rows are the same, else what differs."""
    df = fn(spark, d)
    got = _rows(df.columns, df.collect())
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    want = _rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for g, w in zip(got, want, strict=True):
        if g != w and not all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a))) for a, b in zip(g, w, strict=True)):
            return f"first difference (columns {sorted(names)}): {g} and {w}"
    return ""
