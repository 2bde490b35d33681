"""The list of queries, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from burnish.sources.tables import load_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL to compare it with."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, none of which holds NaN."""
    return load_tables(spark, {name: f"{sf_dir}/{name}.parquet"}, nan_as_null=False)[name]
