"""Compares a Spark query with its DuckDB SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal | float):
        return round(float(v), 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.date | datetime.datetime):
        return str(v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """What differs, or None."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    kinds = dict(zip(names, [str(d[1]) for d in got.description], strict=True))
    want = rows_of(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    have = rows_of(df.columns, df.collect())
    if have != want:
        only = set(map(repr, have)) ^ set(map(repr, want))
        a, b = [x for x in map(repr, have) if x in only][:3], [x for x in map(repr, want) if x in only][:3]
        return f"{len(have)} and {len(want)} rows, {len(only)} differ ({sorted(names)}): {a} / {b}"
    fits = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "array<bigint>": "BIGINT[]", "array<string>": "VARCHAR[]"}
    odd = {c: (k, kinds[c]) for c, k in df.dtypes if fits.get(k) != kinds[c]}
    return f"types {odd}" if odd else None
