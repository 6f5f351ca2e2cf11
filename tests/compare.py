"""Registered queries against DuckDB: equal columns, types of one kind, and the same rows whatever their order."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def plain(value):
    """A value that both engines print alike."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def expected(sql: str, size: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in (DATA / size).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), rows_of(names, found.fetchall())
