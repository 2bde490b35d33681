"""Clipping outliers, or dropping their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import CleaningError, need_choice, need_column
from burnish.functions.numbers import clip, numeric
from burnish.operators.grouped import grouped_stats, with_group_stats
from burnish.operators.joining import LIMITS, JoinLimits
from burnish.operators.stats import MEAN, QUARTILES, STD, Need, measure

METHODS = ("iqr", "zscore", "drop")


def bounds_needed(column: str, method: str) -> list[Need]:
    """The statistics a method derives its bounds from."""
    return [Need(column, MEAN), Need(column, STD)] if method == "zscore" else [Need(column, QUARTILES)]


def _check(df: DataFrame, column: str, method: str, threshold: float) -> None:
    need_column(df, column)
    need_choice("method", method, METHODS)
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)):
        raise CleaningError(f"threshold {threshold!r} is not a number")


def outlier_bounds(
    df: DataFrame,
    column: str,
    method: str = "iqr",
    threshold: float = 1.5,
    stats: dict[Need, object] | None = None,
    exact: bool = True,
) -> tuple[float | None, float | None]:
    """The interval of ordinary values; (None, None) where the column is too empty to tell."""
    _check(df, column, method, threshold)
    needs, known = bounds_needed(column, method), stats or {}
    missing = [n for n in needs if n not in known]
    known = {**known, **(measure(df, missing, exact) if missing else {})}
    if method == "zscore":
        centre, spread = known[needs[0]], known[needs[1]]
        if centre is None or spread is None:
            return None, None
        return centre - threshold * spread, centre + threshold * spread
    low, high = known[needs[0]]
    if low is None or high is None:
        return None, None
    return low - threshold * (high - low), high + threshold * (high - low)


def clip_outliers(
    df: DataFrame,
    column: str,
    method: str = "iqr",
    threshold: float = 1.5,
    bounds: tuple[float | None, float | None] | None = None,
    stats: dict[Need, object] | None = None,
    exact: bool = True,
    partition_by: Sequence[str] = (),
    limits: JoinLimits = LIMITS,
) -> DataFrame:
    """Pull outliers to the bounds, or with ``drop`` remove their rows (and those without a number).

    ``bounds`` skips the statistics pass, which makes the operator usable on a stream. With ``partition_by`` each group of
    rows has bounds of its own, always exact ones.
    """
    if partition_by:
        if bounds:
            raise CleaningError("bounds are given, or found for each group, but not both")
        return _clipped_by_group(df, column, method, threshold, partition_by, limits)
    low, high = bounds or outlier_bounds(df, column, method, threshold, stats, exact)
    need_column(df, column)
    need_choice("method", method, METHODS)
    number = numeric(df, column)
    if method != "drop":
        return df.withColumn(column, clip(number, low, high))
    if low is None or high is None:
        return df.where("false")
    # NaN is above every bound, so numbers can be compared as they are and the scan can filter them.
    plain = F.col(f"`{column}`") if isinstance(df.schema[column].dataType, T.NumericType) else number
    return df.where(plain.between(float(low), float(high)))


def grouped_bounds(
    df: DataFrame, column: str, partition_by: Sequence[str], method: str = "iqr", threshold: float = 1.5
) -> DataFrame:
    """Rows (__group, lower, upper): the interval of ordinary values of each group, null where it is too empty to tell."""
    _check(df, column, method, threshold)
    if method == "zscore":
        stats = grouped_stats(df, column, [MEAN, STD], partition_by)
        low = high = F.col(MEAN)
        spread = F.col(STD)
    else:
        stats = grouped_stats(df, column, [QUARTILES], partition_by)
        low, high = F.col("low"), F.col("high")
        spread = high - low
    reach = F.lit(float(threshold)) * spread
    return stats.select("__group", (low - reach).alias("__lower"), (high + reach).alias("__upper"))


def _clipped_by_group(
    df: DataFrame, column: str, method: str, threshold: float, partition_by: Sequence[str], limits: JoinLimits
) -> DataFrame:
    bounds = grouped_bounds(df, column, partition_by, method, threshold)
    met, number = with_group_stats(df, bounds, partition_by, limits), numeric(df, column)
    low, high = F.col("__lower"), F.col("__upper")
    if method == "drop":
        return met.where(number.between(low, high)).drop("__lower", "__upper")
    # A null bound does not bind.
    clipped = F.when(number.isNotNull(), F.least(F.greatest(number, low), high))
    return met.withColumn(column, clipped).drop("__lower", "__upper")
