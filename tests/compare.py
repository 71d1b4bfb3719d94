"""Compare a Spark result with its SQL counterpart, values and all."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs: columns, row count, first few rows. Empty if all is the same."""
    wanted = con.execute(sql)
    names = [d[0] for d in wanted.description]
    expected = rows_of(names, wanted.fetchall())
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} expected {sorted(names)}")
    if len(expected) != len(found):
        out.append(f"{len(found)} rows, expected {len(expected)}")
    if expected != found:
        extra, lost = sorted(set(found) - set(expected))[:3], sorted(set(expected) - set(found))[:3]
        out.append(f"only in Spark {extra}\nonly in SQL   {lost}")
    return out
