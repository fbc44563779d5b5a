"""Comparing a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata")


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
    return con


def plain(x: object) -> object:
    """Numbers to nine significant digits, so that sums may be taken in any order."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return 0.0 if x == 0 else float(f"{x:.9g}") if math.isfinite(x) else str(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same_rows(df: DataFrame, sql: str, sf: str) -> None:
    got = rows_of(df.columns, df.collect())
    found = duck(sf).execute(sql)
    names = [c[0] for c in found.description]
    want = rows_of(names, found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, wrong[:3]
