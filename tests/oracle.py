"""Compares a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
import os

import duckdb


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return db


def same(frame, db: duckdb.DuckDBPyConnection, sql: str) -> None:
    rows = frame.collect()
    names = sorted(frame.columns)
    found = db.sql(sql)
    assert names == sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    ours = sorted(tuple(_value(r[n]) for n in names) for r in rows)
    theirs = sorted(tuple(_value(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs
