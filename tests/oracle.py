"""Compare a registered query with its DuckDB oracle, order-insensitively."""

from __future__ import annotations

import datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r))
    )


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_names, got = _table(df.columns, [tuple(r) for r in df.collect()])
    relation = con.execute(sql)
    names, want = _table([c[0] for c in relation.description], relation.fetchall())
    if got_names != names:
        return f"columns {got_names} != {names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} != {w}"
    return None
