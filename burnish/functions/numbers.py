"""Turning values into numbers, and keeping numbers within bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.text import strip

# What counts as a number in stripped text, and the characters that mark an amount of money.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
CURRENCY_PATTERN = r"[\$,€£]"


def to_number(text: Column) -> Column:
    """Parse text as a double; anything that is not a plain number becomes null."""
    bare = strip(text)
    return F.when(bare.rlike(NUMBER_PATTERN), bare.try_cast("double"))


def nan_to_null(number: Column) -> Column:
    """NaN marks a missing number; Spark's aggregates only skip real nulls."""
    return F.when(~F.isnan(number), number)


def present(df: DataFrame, column: str) -> Column:
    """The column with NaN turned into null."""
    value = F.col(f"`{column}`")
    return nan_to_null(value) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else value


def numeric(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a double, by the type it has: text is parsed, dates and nested values are null."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return to_number(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return nan_to_null(value.cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    return F.lit(None).cast("double")


def strip_currency(text: Column) -> Column:
    """``$45,200.00`` to 45200.0; text that is still no number becomes null."""
    return to_number(F.regexp_replace(text, CURRENCY_PATTERN, ""))


def clip(number: Column, low: float | None, high: float | None) -> Column:
    """Pull a number into [low, high]; null stays null and a null bound does not bind."""
    bounded = number
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(number.isNotNull(), bounded)
