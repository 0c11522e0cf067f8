"""Compare a Spark result with what DuckDB gives for its twin."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*' )" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, (bool, str, bytes)) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 7) + 0.0
    if isinstance(value, int):
        return round(float(value), 7)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return tuple(plain(v) for v in value)
    return str(value)


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    found = con.sql(sql)
    names, theirs = list(found.columns), found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    at = [names.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in theirs), key=repr)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in order]).collect()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}: {got[:2]} {want[:2]}"
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(wrong)} of {len(got)} rows, {order}: {wrong[0][0]} and {wrong[0][1]}" if wrong else None
