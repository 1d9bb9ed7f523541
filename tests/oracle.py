"""Runs registered queries beside their SQL in DuckDB and compares rows without regard to order."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if Path(path).exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + ('/*.parquet' if os.path.isdir(path) else '')}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9)
    return v


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both sides agree."""
    df = query(spark, sf_dir)
    left = rows(df.columns, [tuple(r) for r in df.collect()])
    got = connection(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    right = rows(names, got.fetchall())
    if left == right:
        return ""
    only = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
    return f"{len(left)} and {len(right)} rows; only in Spark {only[0]}; only in SQL {only[1]}"
