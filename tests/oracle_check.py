"""Compare a Spark result with its SQL oracle, ignoring row order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in data), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def differences(df, sql: str, con, limit: int = 3) -> str | None:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns: spark-only {set(df.columns) - set(names)}, oracle-only {set(names) - set(df.columns)}"
    expected = rows(names, cursor.fetchall())
    actual = rows(df.columns, [tuple(r) for r in df.collect()])
    if len(expected) != len(actual):
        return f"rows: spark {len(actual)}, oracle {len(expected)}"
    shown = [
        [(n, x, y) for n, x, y in zip(sorted(names), a, e) if x != y or type(x) is not type(y)]
        for a, e in zip(actual, expected)
        if any(x != y or type(x) is not type(y) for x, y in zip(a, e))
    ]
    return f"{len(shown)} rows differ, e.g. {shown[:limit]}" if shown else None
