"""Dropping rows by a condition, removing duplicates, appending and shuffling rows."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import CleaningError, need_choice, need_column
from burnish.functions.numbers import numeric, present
from burnish.functions.patterns import pattern
from burnish.operators.ordered import need_order

# What remains when the rows that satisfy a comparison are dropped.
REMAINS = {
    ">": lambda x, v: x <= v,
    "<": lambda x, v: x >= v,
    ">=": lambda x, v: x < v,
    "<=": lambda x, v: x > v,
}
OPERATORS = ("==", "!=", *REMAINS, "isnull", "notnull", "contains")


def drop_rows_by_condition(df: DataFrame, column: str, operator: str, value: object = None) -> DataFrame:
    """Drop the rows for which ``column operator value`` holds.

    A null never satisfies a comparison, so its row stays, but it is always unequal to a value.
    """
    need_column(df, column)
    need_choice("operator", operator, OPERATORS)
    cell = F.col(f"`{column}`")
    if operator == "isnull":
        return df.where(present(df, column).isNotNull())
    if operator == "notnull":
        return df.where(present(df, column).isNull())
    if value is None:
        raise CleaningError(f"operator {operator!r} needs a value")
    if operator == "contains":
        return df.where(~F.coalesce(cell.cast("string").rlike(pattern(str(value))), F.lit(False)))
    if operator in REMAINS:
        number = numeric(df, column)
        return df.where(REMAINS[operator](number, _as_float(value)) | number.isNull())
    if not _comparable(df, column, value):
        return df.where("false") if operator == "!=" else df
    # Plain comparisons and null tests are what a scan can filter by itself.
    return df.where(cell == F.lit(value)) if operator == "!=" else df.where((cell != F.lit(value)) | cell.isNull())


def _comparable(df: DataFrame, column: str, value: object) -> bool:
    """Text never equals a number; dates may be given as text."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, str):
            try:
                datetime.datetime.fromisoformat(value)
            except ValueError as bad:
                raise CleaningError(f"{value!r} is no date to compare column {column!r} with") from bad
        return isinstance(value, (str, datetime.date))
    return isinstance(kind, T.StringType) == isinstance(value, str)


def _as_float(value: object) -> Column:
    try:
        return F.lit(float(value))  # type: ignore[arg-type]
    except (TypeError, ValueError) as bad:
        raise CleaningError(f"{value!r} is not a number") from bad


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Keep one row (the first or last in the order), or with ``none`` no row, of each group of equal rows.

    Null equals null, and NaN counts as null. Every form combines rows before the shuffle, so one group may hold most of the table.
    """
    keep = "none" if keep in (False, "False", "false") else keep
    need_choice("keep", keep, ("first", "last", "none"))
    key = list(dict.fromkeys(subset or df.columns))
    need_column(df, *key)
    rest = [c for c in df.columns if c not in key]
    same = [present(df, c) for c in key]
    if keep == "none":
        # The one row of a group that has only one is any row of it: no join back is needed. Two rows per key and
        # input partition are enough to tell, and windows with a limit prune to that before the shuffle.
        place = F.row_number().over(Window.partitionBy(*same).orderBy(*same))
        two = df.withColumn("__place", place).where("__place <= 2")
        alone = F.count("*").over(Window.partitionBy(*same))
        return two.withColumn("__n", alone).where("__n = 1").drop("__place", "__n")
    if not rest:
        return df.dropDuplicates() if not any(_floating(df, c) for c in key) else _any_of_each(df, same)
    order = _columns(need_order(df, order_by, "keeping the first or last of duplicate rows"))
    sort = [c.asc() if keep == "first" else c.desc() for c in order]
    place = F.row_number().over(Window.partitionBy(*same).orderBy(*sort))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def _any_of_each(df: DataFrame, key: list[Column]) -> DataFrame:
    """One row of each key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def _floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def union_all(df: DataFrame, *others: DataFrame) -> DataFrame:
    """Append the rows of other tables with the same columns."""
    for other in others:
        if set(other.columns) != set(df.columns):
            raise CleaningError(f"cannot append {other.columns} to {df.columns}")
        df = df.unionByName(other)
    return df


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]
