"""Filling, or dropping, missing values."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import CleaningError, need_choice, need_column
from burnish.functions.numbers import present
from burnish.operators.grouped import grouped_stats, with_group_stats
from burnish.operators.joining import LIMITS, JoinLimits
from burnish.operators.ordered import fill_from_neighbour
from burnish.operators.stats import MEAN, MEDIAN, MODE, Need, measure

MEASURED = {"mean": MEAN, "median": MEDIAN, "mode": MODE}
STRATEGIES = (*MEASURED, "forward_fill", "backward_fill", "constant", "drop", "unknown")


def fill_missing(
    df: DataFrame,
    column: str,
    strategy: str = "mean",
    fill_value: object = None,
    order_by: Sequence[str] | None = None,
    partition_by: Sequence[str] = (),
    cast_to_string: bool = False,
    stats: dict[Need, object] | None = None,
    limits: JoinLimits = LIMITS,
) -> DataFrame:
    """Replace the nulls of a column, with ``partition_by`` by what holds in each group of rows.

    A group without any value keeps its nulls. A fill that does not fit the column's type is an error unless ``cast_to_string`` is set. Statistics that
    are already known can be passed in ``stats``; then no job runs and the operator works on a stream, too.
    """
    need_column(df, column)
    need_choice("strategy", strategy, STRATEGIES)
    if strategy == "drop":
        return df.where(present(df, column).isNotNull())
    if strategy in ("forward_fill", "backward_fill"):
        return fill_from_neighbour(df, column, order_by, strategy == "forward_fill", partition_by)
    if strategy == "unknown":
        return df.withColumn(column, F.coalesce(present(df, column).cast("string"), F.lit("unknown")))
    if strategy == "constant":
        if fill_value is None:
            raise CleaningError("strategy 'constant' needs a fill_value")
        return df.withColumn(column, _filled(df, column, fill_value, cast_to_string))
    if partition_by:
        return _filled_by_group(df, column, MEASURED[strategy], partition_by, cast_to_string, limits)
    need = Need(column, MEASURED[strategy])
    known = stats or {}
    value = known[need] if need in known else measure(df, [need])[need]
    if value is None:
        return df
    return df.withColumn(column, _filled(df, column, value, cast_to_string))


def _filled(df: DataFrame, column: str, value: object, cast_to_string: bool) -> Column:
    kind, cell = df.schema[column].dataType, present(df, column)
    if isinstance(value, str) and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = _from_iso(value, kind)
    if fits(value, kind):
        return F.coalesce(cell, F.lit(value).cast(kind))
    if isinstance(kind, T.IntegralType) and isinstance(value, float):
        return F.coalesce(cell.cast("double"), F.lit(value))
    if cast_to_string:
        return F.coalesce(cell.cast("string"), F.lit(str(value)))
    raise CleaningError(f"{value!r} does not fit column {column!r} of type {kind.simpleString()}; see cast_to_string")


def _filled_by_group(
    df: DataFrame, column: str, kind: str, partition_by: Sequence[str], cast_to_string: bool, limits: JoinLimits
) -> DataFrame:
    """Whole numbers stay so if the fills of all groups are whole, as in ``_filled``."""
    stats = grouped_stats(df, column, [kind], partition_by).withColumnRenamed(kind, "__fill")
    held, fill = df.schema[column].dataType, stats.schema["__fill"].dataType
    met = with_group_stats(df, stats, partition_by, limits)
    cell, value = present(df, column), F.col("__fill")
    if isinstance(held, T.IntegralType) and isinstance(fill, T.DoubleType):
        broken = not stats.where(F.col("__fill") % 1 != 0).isEmpty()
        filled = F.coalesce(cell.cast("double"), value) if broken else F.coalesce(cell, value.cast(held))
    elif held == fill or (isinstance(held, T.NumericType) and isinstance(fill, T.NumericType)):
        filled = F.coalesce(cell, value.cast(held))
    elif cast_to_string:
        filled = F.coalesce(cell.cast("string"), value.cast("string"))
    else:
        raise CleaningError(f"the {kind} does not fit column {column!r} of type {held.simpleString()}; see cast_to_string")
    return met.withColumn(column, filled).drop("__fill")


def _from_iso(value: str, kind: T.DataType) -> object:
    """A date or time written in ISO form, as a plan in JSON has to; other text is left as it is."""
    try:
        read = datetime.datetime.fromisoformat(value)
    except ValueError:
        return value
    return read.date() if isinstance(kind, T.DateType) else read


def fits(value: object, kind: T.DataType) -> bool:
    """Whether a Python value can go into a column of this type without changing either."""
    if isinstance(value, bool) or isinstance(kind, T.BooleanType):
        return isinstance(value, bool) and isinstance(kind, T.BooleanType)
    if isinstance(kind, T.IntegralType):
        return isinstance(value, (int, float)) and float(value).is_integer()
    if isinstance(kind, T.NumericType):
        return isinstance(value, (int, float, decimal.Decimal))
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return isinstance(value, datetime.datetime)
    return isinstance(kind, T.DateType) and isinstance(value, datetime.date) and not isinstance(value, datetime.datetime)
