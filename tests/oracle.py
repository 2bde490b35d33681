"""Comparing a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A value in a form that both engines share; types that differ stay different."""
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return ("date", value.isoformat())
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return ("float", 0.0 if value == 0 else value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, run, sql):
    """None if both give the same columns and rows, otherwise what differs."""
    df = run(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    want = canonical(names, relation.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:3]
    lacking = [r for r in want if r not in set(got)][:3]
    return f"{len(got)} rows instead of {len(want)}; only in Spark: {extra}; only in SQL: {lacking}"
