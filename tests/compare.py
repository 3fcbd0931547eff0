"""Rows of a query against rows of its SQL."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float) or isinstance(x, Decimal):
        return round(float(x), 6)
    return x


def rows(columns: list[str], data) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(plain(r[i]) for i in order)) for r in data))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def differs(df, sql: str, con) -> str:
    """What differs between a DataFrame and SQL, or an empty string."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, got.fetchall())
    if a == b:
        return ""
    first = next(((x, y) for x, y in zip(a, b) if x != y), ("", ""))
    return f"{len(a)} and {len(b)} rows; first difference {first}"
