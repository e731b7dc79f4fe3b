"""Spark results against DuckDB's, row by row."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, row)) for row in df.select(*names).collect()), key=str)
    relation = con.sql(sql)
    assert sorted(relation.columns) == names
    want = sorted((tuple(map(plain, row)) for row in relation.select(*(f'"{n}"' for n in names)).fetchall()), key=str)
    assert got == want
