"""Runs a query and its SQL on the same parquet files and compares the rows, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "tolist"):
        return tuple(_plain(v) for v in value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def both(spark, folder: str, name: str, queries: dict, sql: dict):
    df = queries[name](spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(folder).execute(sql[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    return got, _rows(names, rel.fetchall())
