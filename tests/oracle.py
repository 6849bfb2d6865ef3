"""Comparison of a query's rows with those of its DuckDB SQL."""

from pathlib import Path

import duckdb
import numpy as np


def connection(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _cell(v) -> str:
    if v is None or (isinstance(v, (float, np.floating)) and np.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def cells(frame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, row)) for row in frame.itertuples(index=False))


def same(spark, con, query, sql: str, sf_dir: str) -> None:
    ours, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)
