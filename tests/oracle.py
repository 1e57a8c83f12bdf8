"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA:
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "null" if math.isnan(v) else str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.5g}"
    if isinstance(v, (list, tuple)):
        return f"[{','.join(map(cell, v))}]"
    return str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(cell, r)) for r in frame.itertuples(index=False, name=None))


def same(spark_frame, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    mine, theirs = spark_frame.toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
