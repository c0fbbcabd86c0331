"""Compare a query with its SQL counterpart: same columns, same rows in any order."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str | None:
    """What differs, or None; also returns on differing column types of interest."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    want = rows_of(names, expected.fetchall())
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want == have:
        return None
    return (
        f"{sum(have.values())} rows instead of {sum(want.values())}; "
        f"only here: {list((have - want).items())[:3]}; "
        f"only expected: {list((want - have).items())[:3]}"
    )
