"""Runs a query on Spark and its SQL on DuckDB and compares the rows without regard to order."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None if value is None else "NaN"
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, Decimal)):
        return repr(float(value) + 0.0) if isinstance(value, float) else str(value.normalize())
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(cell(x) for x in value)
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(cell(r[i]) for i in order) for r in records)


def duck(directory):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(directory).glob("*.parquet"):
        at = p / "*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{at}'")
    return con


def difference(spark, query, sql, directory):
    """('', row count) if both agree, else what differs."""
    df = query(spark, directory)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(directory).execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}", 0
    extra, missing = got[1] - want[1], want[1] - got[1]
    if extra or missing:
        return f"{sum(got[1].values())} rows for {sum(want[1].values())}; {sum(extra.values())} extra {list(extra)[:3]}, {sum(missing.values())} missing {list(missing)[:3]}", 0
    return "", sum(got[1].values())
