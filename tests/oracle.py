"""Compares a query's rows with its SQL's, as the driver does: by column name, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(str(_value(v)) for v in x) + "]"
    if x is None:
        return "~"
    return str(x)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """An empty string if they agree, else what differs."""
    df = query(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    theirs = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(rel.columns)}"
    a, b = rows_of(df.columns, mine), rows_of(rel.columns, theirs)
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{name}: {len(a)} and {len(b)} rows; only here {only_a}; only there {only_b}"
    return ""
