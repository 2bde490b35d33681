"""Renaming, dropping, picking and casting columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import CleaningError, need_choice, need_column
from burnish.functions.formats import parse_date
from burnish.functions.numbers import numeric
from burnish.operators.stats import WHOLE, Need, measure

DTYPES = ("int", "integer", "float", "str", "string", "datetime", "bool", "category")
ON_FRACTION = ("fail", "null", "round")


def rename_column(df: DataFrame, old_name: str, new_name: str) -> DataFrame:
    """Rename a column. Spark would ignore an absent name and allow two equal ones; both are errors here."""
    need_column(df, old_name)
    if new_name != old_name and new_name in df.columns:
        raise CleaningError(f"column {new_name!r} exists already")
    return df.withColumnRenamed(old_name, new_name)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    """Remove a column."""
    need_column(df, column)
    return df.drop(column)


def select_columns(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The key and the wanted columns that exist, in the order in which they were asked for."""
    need_column(df, key)
    wanted = [c for c in dict.fromkeys([key, *columns]) if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def cast_column(
    df: DataFrame, column: str, dtype: str, on_fraction: str = "fail", stats: dict[Need, object] | None = None
) -> DataFrame:
    """Change the type of a column; values that cannot be read in it become null.

    An integer cast fails as a whole if a number has a fractional part, unless ``on_fraction`` says otherwise.
    """
    need_column(df, column)
    need_choice("dtype", dtype, DTYPES)
    need_choice("on_fraction", on_fraction, ON_FRACTION)
    if dtype in ("int", "integer"):
        return df.withColumn(column, _whole_number(df, column, on_fraction, stats or {}))
    return df.withColumn(column, _cast(df, column, dtype))


def _cast(df: DataFrame, column: str, dtype: str) -> Column:
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if dtype == "float":
        return numeric(df, column)
    if dtype == "datetime":
        if isinstance(kind, T.StringType):
            return parse_date(value)
        return value.try_cast("timestamp_ntz") if _is_time(kind) else F.lit(None).cast("timestamp_ntz")
    if dtype == "bool":
        if isinstance(kind, T.NumericType):
            return numeric(df, column) != 0
        return value.try_cast("boolean") if isinstance(kind, (T.StringType, T.BooleanType)) else F.lit(None).cast("boolean")
    return value.cast("string")


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _whole_number(df: DataFrame, column: str, on_fraction: str, stats: dict[Need, object]) -> Column:
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    number = numeric(df, column)
    if on_fraction == "round":
        return F.round(number).try_cast("bigint")
    if on_fraction == "fail":
        need = Need(column, WHOLE)
        whole = stats[need] if need in stats else measure(df, [need])[need]
        if not whole:
            raise CleaningError(f"column {column!r} holds numbers with a fractional part")
        return number.try_cast("bigint")
    return F.when(number % 1 == 0, number.try_cast("bigint"))
