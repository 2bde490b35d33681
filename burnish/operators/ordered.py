"""Operators that follow a row order the caller names: fills from neighbours, ranks, first rows.

A window over one huge group would run in one task. Groups above ``MAX_GROUP_ROWS`` are therefore cut into
ranges of the order, and each range gets what it needs to know about the earlier ones as one more row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import CleaningError, need_column
from burnish.functions.numbers import present
from burnish.operators.joining import is_small
from burnish.operators.scratch import settle
from burnish.operators.stats import ACCURACY, GUIDE_ROWS

# Rows one task may sort as a single group. Up to so many ranges are cut at percentiles, more by sorting; and so many
# neighbouring ranges are looked at together where something is carried from range to range.
MAX_GROUP_ROWS = 1_000_000
MAX_PERCENTILES = 10_000
BLOCK_OF_RANGES = 1_000
LIST_BYTES = 64 * 1024 * 1024

_RANGE, _REAL = "__range", "__real"
# The range of rows whose group is not cut. (-1 is the range of rows without a place in the order.)
WHOLE_GROUP = -2


def need_order(df: DataFrame, order_by: Sequence[str] | None, what: str) -> list[str]:
    """Rows have no order of their own; an operator that depends on one has to be told."""
    if not order_by:
        raise CleaningError(f"{what} depends on row order: pass order_by, columns that put all rows in order")
    need_column(df, *order_by)
    return list(order_by)


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def fill_from_neighbour(
    df: DataFrame,
    column: str,
    order_by: Sequence[str] | None,
    forward: bool = True,
    partition_by: Sequence[str] = (),
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Fill nulls with the last (or, backward, the next) non-null value in the order, within each group.

    NaN counts as null, in the column and in the group.
    """
    order = need_order(df, order_by, "filling from a neighbouring row")
    groups = list(partition_by)
    need_column(df, column, *groups)
    df = df.withColumns({c: present(df, c) for c in (column, *groups) if _floating(df, c)})
    sort = [c.asc() if forward else c.desc() for c in _columns(order)]
    value = F.col(f"`{column}`")
    sizes = df.groupBy(*_columns(groups)).count() if groups else df.agg(F.count("*").alias("count"))
    total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    if (largest or 0) <= max_group_rows:
        nearest = F.last(value, ignorenulls=True).over(Window.partitionBy(*_columns(groups)).orderBy(*sort))
        return df.withColumn(column, F.coalesce(value, nearest))

    cut = with_ranges(df, order, total, max_group_rows)
    if groups:
        cut = _only_large_groups(cut, sizes.where(F.col("count") > max_group_rows), groups)
    carry = _carried(cut, column, groups, order, forward)
    rows = cut.withColumn(_REAL, F.lit(1)).unionByName(carry.withColumn(_REAL, F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(_RANGE, *_columns(groups)).orderBy(F.col(_REAL).asc(), *sort)
    filled = rows.withColumn(column, F.coalesce(value, F.last(value, ignorenulls=True).over(inside)))
    return filled.where(F.col(_REAL) == 1).select(*_columns(df.columns))


def _only_large_groups(cut: DataFrame, large: DataFrame, groups: list[str]) -> DataFrame:
    """Give all rows of a group that is small enough the same range, ``WHOLE_GROUP``.

    The list of large groups is broadcast if it is small: each stands for more than ``max_group_rows`` rows.
    """
    names = [f"__g{i}" for i in range(len(groups))]
    listed = large.select(*[F.col(f"`{g}`").alias(n) for g, n in zip(groups, names)], F.lit(True).alias("__large"))
    same = reduce(Column.__and__, [F.col(f"`{g}`").eqNullSafe(F.col(n)) for g, n in zip(groups, names)])
    marked = cut.join(_listed(listed), same, "left")
    kept = F.when(F.col("__large"), F.col(_RANGE)).otherwise(F.lit(WHOLE_GROUP))
    return marked.withColumn(_RANGE, kept).drop("__large", *names)


def _listed(df: DataFrame) -> DataFrame:
    """A side of a join, to be broadcast if it was counted to be small."""
    return F.broadcast(df) if is_small(df, LIST_BYTES) else df


def _block() -> Column:
    return F.floor(F.col(_RANGE) / BLOCK_OF_RANGES)


def _carried(cut: DataFrame, column: str, groups: list[str], order: list[str], forward: bool) -> DataFrame:
    """Per range and group, the value that reaches it from the ranges before; at most one row per range and group.

    It comes from earlier ranges of the same block, or else from the blocks before, so no task sees all ranges.
    """
    value = F.col(f"`{column}`")
    position = F.when(value.isNotNull(), F.struct(*_columns(order)))
    edge = F.max_by(value, position) if forward else F.min_by(value, position)
    edges = cut.where(F.col(_RANGE) != WHOLE_GROUP).groupBy(_RANGE, *_columns(groups)).agg(edge.alias("__edge"))
    edges = edges.withColumn("__block", _block())
    last = F.max_by if forward else F.min_by
    known = F.when(F.col("__edge").isNotNull(), F.col(_RANGE))
    blocks = edges.groupBy("__block", *_columns(groups)).agg(last("__edge", known).alias("__last"))
    earlier = lambda step, *within: (
        Window.partitionBy(*within, *_columns(groups))
        .orderBy(F.col(step).asc() if forward else F.col(step).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = blocks.withColumn("__before", F.last("__last", ignorenulls=True).over(earlier("__block"))).drop("__last")
    names = {g: f"__of_{i}" for i, g in enumerate(groups)}
    blocks = blocks.select(F.col("__block").alias("__of"), "__before", *[F.col(f"`{g}`").alias(n) for g, n in names.items()])
    same = reduce(Column.__and__, [F.col(f"`{g}`").eqNullSafe(F.col(n)) for g, n in names.items()], F.col("__block") == F.col("__of"))
    carry = edges.withColumn(column, F.last("__edge", ignorenulls=True).over(earlier(_RANGE, "__block")))
    met = carry.join(blocks, same, "left").withColumn(column, F.coalesce(value, "__before"))
    return met.where(value.isNotNull()).drop("__edge", "__block", "__of", "__before", *names.values())


def with_ranges(df: DataFrame, order: Sequence[str], total: int, rows_per_range: int) -> DataFrame:
    """Add ``__range``: numbers that rise with the order and split the rows into parts of similar size.

    A leading number or time is cut at approximate percentiles, which needs no shuffle. Leading text, or one
    leading value that fills several parts, is cut by sorting ranges of the whole order; those are written to
    the shared folder once, so that every later pass sees the same ranges.
    """
    parts = max(2, math.ceil(2 * total / max(1, rows_per_range)))
    place = _position(df, order[0])
    if place is not None and parts <= MAX_PERCENTILES:
        shares = [i / parts for i in range(1, parts)]
        guide = df.select(place.alias("place"))
        guide = guide.sample(GUIDE_ROWS / total, seed=total) if total > GUIDE_ROWS else guide
        splits = guide.agg(F.percentile_approx("place", shares, max(ACCURACY, 10 * parts))).first()[0] or []
        if splits and max(Counter(splits).values()) <= 2:
            bounds = [-math.inf, *sorted(set(splits)), math.inf]
            cutter = Bucketizer(splits=bounds, inputCol="__place", outputCol=_RANGE, handleInvalid="keep")
            cut = cutter.transform(df.withColumn("__place", place))
            known = F.when(F.col("__place").isNotNull(), F.col(_RANGE)).otherwise(F.lit(-1.0))
            return cut.withColumn(_RANGE, known.cast("int")).drop("__place")
    ranged = df.repartitionByRange(parts, *_columns(order)).withColumn(_RANGE, F.spark_partition_id())
    return settle(ranged)


def _position(df: DataFrame, name: str) -> Column | None:
    """A number that never falls as the column rises, or None where there is no cheap one."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        days = F.unix_date(value.cast("date")).cast("double") * 86400
        return days if isinstance(kind, T.DateType) else days + F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
    return None


def ranked_values(df: DataFrame, column: str, rank: str, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Rows (column, rank): the different non-null values and their zero-based places in ascending order."""
    need_column(df, column)
    value = F.col(f"`{column}`")
    values = df.select(present(df, column).alias(column)).where(value.isNotNull()).distinct()
    total = values.count()
    if total <= max_group_rows:
        return values.withColumn(rank, (F.row_number().over(Window.orderBy(value)) - 1).cast("long"))
    cut = with_ranges(values, [column], total, max_group_rows)
    sizes = cut.groupBy(_RANGE).count().withColumn("__block", _block())
    before = lambda step, *within: Window.partitionBy(*within).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("__block").agg(F.sum("count").alias("count"))
    blocks = blocks.select("__block", F.coalesce(F.sum("count").over(before("__block")), F.lit(0)).alias("__blocks"))
    starts = sizes.withColumn("__ranges", F.coalesce(F.sum("count").over(before(_RANGE, "__block")), F.lit(0))).join(blocks, "__block")
    starts = starts.select(_RANGE, (F.col("__blocks") + F.col("__ranges")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(_RANGE).orderBy(value)) - 1
    placed = cut.withColumn("__inside", inside).join(_listed(starts), _RANGE)
    return placed.select(value, (F.col("__start") + F.col("__inside")).cast("long").alias(rank))


def head_rows(df: DataFrame, order_by: Sequence[str] | None, n: int = 3) -> DataFrame:
    """The first ``n`` rows in the order."""
    return df.orderBy(*_columns(need_order(df, order_by, "taking the first rows"))).limit(n)


def sample_values(df: DataFrame, order_by: Sequence[str] | None, n: int = 5, look_at: int = 20) -> DataFrame:
    """Rows (column_name, sample_values): the first ``n`` non-null values of every column, in the order, as text.

    The first ``look_at`` rows nearly always hold them; only columns with fewer values there are looked up
    on their own, each reading just itself and the order.
    """
    order = need_order(df, order_by, "sampling values")
    df = df.withColumns({c: present(df, c) for c in df.columns if _floating(df, c) and c not in order})
    top = df.orderBy(*_columns(order)).limit(look_at)
    place = Window.orderBy(*[F.col(f"__order.`{c}`") for c in order])
    keyed = top.select(F.struct(*_columns(order)).alias("__order"), *_columns(df.columns))
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns
    ]
    numbered = keyed.withColumn("__n", F.row_number().over(place)).select("__n", F.inline(F.array(*cells)))
    first = Window.partitionBy("column_name").orderBy("__n")
    kept = (
        numbered.where("value IS NOT NULL")
        .withColumn("__k", F.row_number().over(first))
        .where(F.col("__k") <= n)
        .groupBy("column_name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "value"))), lambda s: s["value"]).alias("sample_values"))
    ).collect()
    found = {r["column_name"]: r["sample_values"] for r in kept}
    sparse = [c for c in df.columns if len(found.get(c, [])) < n]
    if sparse:
        found.update(_first_values(df, sparse, order, n))
    return df.sparkSession.createDataFrame(
        [(c, found.get(c, [])) for c in df.columns], "column_name string, sample_values array<string>"
    )


def _first_values(df: DataFrame, names: list[str], order: list[str], n: int) -> dict[str, list[str]]:
    """The first non-null values of some columns, each looked for in the whole table, all in one job."""
    tails = [
        df.where(F.col(f"`{c}`").isNotNull())
        .orderBy(*_columns(order))
        .limit(n)
        .agg(F.lit(c).alias("column_name"), F.array_sort(F.collect_list(_placed(c, order))).alias("values"))
        for c in names
    ]
    rows = reduce(DataFrame.union, tails).select("column_name", F.transform("values", lambda v: v["value"])).collect()
    return {r[0]: r[1] for r in rows}


def _placed(name: str, order: list[str]) -> Column:
    return F.struct(F.struct(*_columns(order)).alias("place"), F.col(f"`{name}`").cast("string").alias("value"))
