"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import datetime
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), Counter(tuple(plain(row[k]) for k in order) for row in rows)


def near(a, b):
    return isinstance(a, float | int) and isinstance(b, float | int) and not isinstance(a, bool) and math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-6)


def differences(df, con, sql):
    """What differs between a frame and the SQL's result; empty if nothing does."""
    got_names, got = bag(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_names, want = bag([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} and {want_names}"]
    left, right = list((got - want).elements()), list((want - got).elements())
    if len(left) == len(right):  # floats may differ in their last places
        key = lambda r: tuple((x is None, str(type(x)), f"{x:.4g}" if isinstance(x, float) else str(x)) for x in r)
        left, right = sorted(left, key=key), sorted(right, key=key)
        if all(all(x == y or near(x, y) for x, y in zip(a, b, strict=True)) for a, b in zip(left, right, strict=True)):
            return []
    return [f"{sum(got.values())} rows against {sum(want.values())}; only here {left[:2]}; only there {right[:2]}"]
