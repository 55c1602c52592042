"""Holds a query's rows against those of its SQL in DuckDB over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(DATA.glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def assert_same(spark, con, query, sql: str) -> None:
    df = query(spark, str(DATA))
    names = sorted(df.columns)
    mine = sorted(repr([r[c] for c in names]) for r in df.collect())
    out = con.sql(sql)
    assert sorted(out.columns) == names
    at = [out.columns.index(c) for c in names]
    theirs = sorted(repr([r[i] for i in at]) for r in out.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
