"""Compare a Spark result with the same query run by DuckDB on the same files."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("WEBFACTS_TESTDATA", "/root/testdata")


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _kind(v):
    return "none" if v is None else type(v).__name__


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    right = rel.fetchall()
    left = spark_df.collect()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    order = sorted(names)
    li = [spark_df.columns.index(c) for c in order]
    ri = [names.index(c) for c in order]
    a = sorted((tuple(_cell(r[i]) for i in li) for r in left), key=repr)
    b = sorted((tuple(_cell(r[i]) for i in ri) for r in right), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first spark {a[:2]} duck {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{order}\n  spark {x}\n  duck  {y}"
        for c, u, v in zip(order, x, y):
            if u is not None and v is not None and _kind(u) != _kind(v):
                return f"type of {c}: spark {u!r} duck {v!r}"
    return None
