"""Run a query in Spark and its counterpart in DuckDB and compare rows, whatever their order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def cell(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x).removesuffix(" 00:00:00")


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def same(spark, query, sql: str, sf_dir: str = SF) -> None:
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
