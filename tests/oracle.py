"""Runs a registered query and its SQL twin and compares whole results."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    key = lambda row: tuple((v is None, "" if v is None else str(v)) for v in row)
    return sorted((tuple(row[n] for n in order) for row in rows), key=key), sorted(columns)


def difference(df, con, sql: str) -> str:
    """Empty if both results hold the same rows, else the first difference."""
    table = df.toArrow()
    got, got_names = _sorted(df.columns, zip(*[c.to_pylist() for c in table.columns]) if table.num_rows else [])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want, want_names = _sorted(names, cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""
