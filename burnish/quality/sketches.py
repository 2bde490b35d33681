"""A profile that grows with its table: sketches of each part are kept, and merged to those of the whole.

A table that grows by parts (days, files) is read once: its new parts are sketched and their sketches written beside the
old ones; the profile of any set of parts comes from a few kilobytes per part and column. Row and null counts, sums,
smallest and largest numbers are exact. Distinct counts are off by about 1.6 % (HyperLogLog, standard error), ranks of
quantiles by less than 2 % of the numbers (KLL), counts of frequent values by at most 0.2 % of the values; columns of up
to a few hundred different values have exact counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.errors import CleaningError, need_column
from burnish.functions.numbers import numeric, present

# Sizes of the sketches: registers as a power of two, numbers kept per level, and values followed.
DISTINCT_BITS, RANK_SIZE, TRACKED = 12, 200, 1000
# Merging goes by way of so many groups per column, so that no task gets the sketches of all parts.
MERGE_GROUPS = 64

_MERGED_RANKS = (
    "reduce(collect_list(ranks), CAST(NULL AS BINARY), (a, b) -> CASE WHEN a IS NULL THEN b ELSE kll_sketch_merge_double(a, b) END)"
)


def column_sketches(df: DataFrame, columns: Sequence[str] | None = None, part_by: Sequence[str] = ()) -> DataFrame:
    """One row per column, and per part if ``part_by`` names the columns that tell parts apart.

    Columns are column_name, values, nulls, numbers, total, low, high, and the sketches distinct, ranks and frequent. One
    pass; tasks combine their rows to sketches before the shuffle. Values are compared as text, and NaN is null.
    """
    need_column(df, *(columns or ()), *part_by)
    chosen = [c for c in columns or df.columns if c not in part_by]
    if not chosen:
        raise CleaningError("no column is left to describe")
    cells = [
        x
        for i, c in enumerate(chosen)
        for x in (present(df, c).cast("string").alias(f"v{i}"), numeric(df, c).alias(f"x{i}"))
    ]
    narrow = df.select(*[F.col(f"`{p}`").alias(f"__part{i}") for i, p in enumerate(part_by)], *cells)
    aggregates = [F.count("*").alias("rows")]
    for i in range(len(chosen)):
        aggregates += [
            F.count(f"v{i}").alias(f"n{i}"), F.count(f"x{i}").alias(f"numbers{i}"), F.sum(f"x{i}").alias(f"total{i}"),
            F.min(f"x{i}").alias(f"low{i}"), F.max(f"x{i}").alias(f"high{i}"),
            F.hll_sketch_agg(f"v{i}", DISTINCT_BITS).alias(f"distinct{i}"),
            F.expr(f"kll_sketch_agg_double(x{i}, {RANK_SIZE})").alias(f"ranks{i}"),
            F.expr(f"approx_top_k_accumulate(v{i}, {TRACKED}) FILTER (WHERE v{i} IS NOT NULL)").alias(f"frequent{i}"),
        ]
    parts = [f"__part{i}" for i in range(len(part_by))]
    found = narrow.groupBy(*parts).agg(*aggregates)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"n{i}").alias("values"),
            (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
            *[F.col(f"{n}{i}").alias(n) for n in ("numbers", "total", "low", "high", "distinct")],
            F.when(F.col(f"numbers{i}") > 0, F.col(f"ranks{i}")).alias("ranks"),
            F.col(f"frequent{i}").alias("frequent"),
        )
        for i, c in enumerate(chosen)
    ]
    return found.select(*[F.col(p).alias(n) for p, n in zip(parts, part_by)], F.inline(F.array(*rows)))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketches of a whole table, one row per column, from those of its parts."""
    names = ("column_name", "values", "nulls", "numbers", "total", "low", "high", "distinct", "ranks", "frequent")
    together = sketches[0].select(*names)
    for more in sketches[1:]:
        together = together.unionByName(more.select(*names))
    grouped = together.withColumn("__group", F.pmod(F.xxhash64("distinct", "total", "nulls"), F.lit(MERGE_GROUPS)))
    return _merged(_merged(grouped, "column_name", "__group"), "column_name").select(*names)


def _merged(sketches: DataFrame, *keys: str) -> DataFrame:
    sums: list[Column] = [F.sum(n).alias(n) for n in ("values", "nulls", "numbers", "total")]
    return sketches.groupBy(*keys).agg(
        *sums,
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.expr(_MERGED_RANKS).alias("ranks"),
        F.expr("approx_top_k_combine(frequent)").alias("frequent"),
    )


def profile_of(sketches: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), most_frequent: int = 5) -> DataFrame:
    """What merged sketches say of each column: counts, low, high, mean, about how many different values, quantiles, and
    the most frequent values as (item, count). Columns without numbers, or without values, have nulls there.
    """
    if not all(0 <= q <= 1 for q in quantiles) or not 0 < most_frequent <= TRACKED:
        raise CleaningError(f"bad quantiles {quantiles} or number of values {most_frequent}")
    shares = F.array(*[F.lit(float(q)) for q in quantiles])
    at = F.call_function("kll_sketch_get_quantile_double", F.col("ranks"), shares)
    top = F.expr(f"approx_top_k_estimate(frequent, {int(most_frequent)})")
    return sketches.select(
        "column_name", "values", "nulls", "low", "high",
        F.when(F.col("numbers") > 0, F.col("total") / F.col("numbers")).alias("mean"),
        F.hll_sketch_estimate("distinct").alias("distinct_values"),
        F.when(F.col("ranks").isNotNull(), at).alias("quantiles"),
        F.when(F.col("values") > 0, top).alias("most_frequent"),
    )
