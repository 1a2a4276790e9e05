"""Runs a query in Spark and its SQL in DuckDB over the same tables, and compares rows as multisets."""

import datetime
import glob
import math
import os
from collections import Counter

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def kind(v) -> str:
    return "number" if isinstance(v, float) else type(v).__name__


def compare(df, con, sql: str) -> str:
    """What differs; empty if nothing does."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = [tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in cursor.fetchall()]
    got = [tuple(plain(v) for _, v in sorted(zip(df.columns, r, strict=True))) for r in df.collect()]
    for a, b in zip(zip(*got, strict=True), zip(*want, strict=True), strict=False):
        x, y = ({kind(v) for v in c if v is not None} for c in (a, b))
        if x and y and x != y:
            return f"types {x} and {y} in {list(zip(sorted(names), got[0], want[0], strict=True))}"
    if Counter(got) != Counter(want):
        more, less = Counter(got) - Counter(want), Counter(want) - Counter(got)
        return f"{len(got)} and {len(want)} rows; only Spark: {list(more)[:2]}; only SQL: {list(less)[:2]}"
    return ""
