"""Spark against DuckDB on the same tables."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connection(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v: object) -> str:
    if isinstance(v, (float, decimal.Decimal)):
        return "NaN" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(columns: list[str], data: list) -> list[tuple[str, ...]]:
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in by) for r in data)


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())
