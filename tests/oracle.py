"""Compares registered queries with their SQL on DuckDB: columns, row counts, values."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if abs(x) > 1e12 else round(x, 4)
    return str(x) if x is not None and not isinstance(x, (int, bool)) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_value(r[i]) for i in order) for r in data], key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if equal."""
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = rows(want_columns, cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {df.columns} / {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, {len(want)} wanted"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} rows differ: {bad[0]}" if bad else ""
