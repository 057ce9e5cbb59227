"""Runs a query's SQL in DuckDB over the same tables, and compares rows without regard to order."""

from __future__ import annotations

import glob
import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return c


def same_rows(df, sql: str, sf_dir: str) -> None:
    cursor = views(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in cursor.fetchall())
    got = sorted(repr(tuple(r[c] for c in sorted(names))) for r in df.collect())
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not wrong, wrong[:2]
