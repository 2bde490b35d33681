"""Statistics per group, exact for any number of groups of any size.

Values are counted first, by group and value, which combines equal ones before the shuffle. For quantiles the counted
values are sorted by range over the whole table, so that a group that holds much of it lies in many tasks; the counts
before each range of a group give every value its ranks, and whoever holds a wanted rank reports it. No task ever holds
a group, and the number of passes does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.errors import CleaningError, need_column
from burnish.functions.numbers import numeric, present
from burnish.operators.joining import LIMITS, JoinLimits, equi_join
from burnish.operators.scratch import settle
from burnish.operators.stats import MAX, MEAN, MEDIAN, MIN, MODE, QUARTILES, STD

_GROUP = "__group"
_PLAIN = {MEAN: F.avg, STD: F.stddev_samp, MIN: F.min, MAX: F.max}


def group_key(df: DataFrame, partition_by: Sequence[str]) -> Column:
    """The columns of a group as one value; null equals null, and NaN counts as null."""
    if not partition_by:
        raise CleaningError("statistics per group need the columns that make a group")
    need_column(df, *partition_by)
    return F.struct(*[present(df, c).alias(f"g{i}") for i, c in enumerate(partition_by)])


def grouped_quantiles(values: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Rows (__group, q0, q1, ...) for ``values`` (__group, x), by linear interpolation between neighbours; x is not null."""
    counted = values.groupBy(_GROUP, "x").agg(F.count("*").alias("n"))
    ranged = settle(counted.repartitionByRange(_GROUP, "x").withColumn("part", F.spark_partition_id()))
    of_parts = ranged.groupBy(_GROUP, "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(_GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(_GROUP)
    starts = of_parts.select(
        _GROUP, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("rows")
    )
    inside = Window.partitionBy(_GROUP, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    # All rows of a group and range are in one task already and stay together: both sides share their partitioning.
    upto = ranged.withColumn("upto", F.sum("n").over(inside)).join(starts, [_GROUP, "part"])
    upto = upto.withColumn("upto", F.col("upto") + F.col("start"))
    wanted = []
    for i, p in enumerate(shares):
        place = F.lit(float(p)) * (F.col("rows") - 1)
        for name, rank in ((f"l{i}", F.floor(place)), (f"h{i}", F.ceil(place))):
            wanted.append(F.min(F.when(F.col("upto") > rank, F.col("x"))).alias(name))
    found = upto.groupBy(_GROUP).agg(F.max("rows").alias("rows"), *wanted)
    out = []
    for i, p in enumerate(shares):
        place = F.lit(float(p)) * (F.col("rows") - 1)
        share = place - F.floor(place)
        between = (1 - share) * F.col(f"l{i}") + share * F.col(f"h{i}")
        out.append(F.when(F.col(f"l{i}") == F.col(f"h{i}"), F.col(f"l{i}")).otherwise(between).alias(f"q{i}"))
    return found.select(_GROUP, *out)


def grouped_modes(values: DataFrame) -> DataFrame:
    """Rows (__group, mode) for ``values`` (__group, x): the most frequent value, the smallest one in a tie."""
    counted = values.groupBy(_GROUP, "x").agg(F.count("*").alias("n"))
    return counted.groupBy(_GROUP).agg(F.min(F.struct((-F.col("n")).alias("n"), "x"))["x"].alias(MODE))


def grouped_stats(df: DataFrame, column: str, kinds: Sequence[str], partition_by: Sequence[str]) -> DataFrame:
    """Rows (__group, one column per kind) with the statistics of a column; quartiles are ``low`` and ``high``.

    Groups without a value are left out.
    """
    need_column(df, column)
    key = group_key(df, partition_by)
    numbers = df.select(key.alias(_GROUP), numeric(df, column).alias("x")).where("x IS NOT NULL")
    parts = []
    plain = [k for k in kinds if k in _PLAIN]
    if plain:
        parts.append(numbers.groupBy(_GROUP).agg(*[_PLAIN[k]("x").alias(k) for k in plain]))
    shares = ([0.5] if MEDIAN in kinds else []) + ([0.25, 0.75] if QUARTILES in kinds else [])
    if shares:
        names = ([MEDIAN] if MEDIAN in kinds else []) + (["low", "high"] if QUARTILES in kinds else [])
        parts.append(grouped_quantiles(numbers, shares).toDF(_GROUP, *names))
    if MODE in kinds:
        parts.append(grouped_modes(df.select(key.alias(_GROUP), present(df, column).alias("x")).where("x IS NOT NULL")))
    return settle(reduce(lambda a, b: a.join(b, _GROUP, "full"), parts))


def with_group_stats(df: DataFrame, stats: DataFrame, partition_by: Sequence[str], limits: JoinLimits = LIMITS) -> DataFrame:
    """``df`` with the statistics of each row's group; the rows of a very large group are spread over many tasks."""
    keyed = df.withColumn(_GROUP, group_key(df, partition_by))
    side = stats.withColumnRenamed(_GROUP, "__of_group")
    return equi_join(keyed, side, _GROUP, "__of_group", "left", False, limits).drop(_GROUP, "__of_group")
