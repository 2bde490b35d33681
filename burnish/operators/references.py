"""Relations between tables: merging, and foreign keys without a parent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.errors import CleaningError, need_choice, need_column
from burnish.operators.columns import select_columns
from burnish.operators.joining import LIMITS, JoinLimits, equi_join, lookup, same_key_type

HOWS = ("left", "inner", "right", "outer")


def table(tables: Mapping[str, DataFrame] | None, name: str) -> DataFrame:
    """An auxiliary table by name."""
    if not tables or name not in tables:
        raise CleaningError(f"no such table {name!r}; available: {list(tables or {})}")
    return tables[name]


def merge_tables(
    df: DataFrame,
    right_table: str,
    left_on: str,
    right_on: str,
    how: str = "left",
    columns: Sequence[str] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    match_nulls: bool = True,
    limits: JoinLimits = LIMITS,
) -> DataFrame:
    """Join a named table. A repeated key on the right multiplies rows, and null keys match each other.

    Keys of the same name appear once; other right columns whose name is taken get the suffix ``_{right_table}``.
    """
    right = table(tables, right_table)
    need_choice("how", how, HOWS)
    need_column(df, left_on)
    need_column(right, right_on)
    same_key_type(df, left_on, right, right_on)
    if columns:
        right = select_columns(right, right_on, columns)
    shared = left_on == right_on
    names = {
        c: f"{c}_{right_table}" if c in df.columns else c for c in right.columns if not (shared and c == right_on)
    }
    clash = [n for n in names.values() if n in df.columns or list(names.values()).count(n) > 1]
    if clash:
        raise CleaningError(f"merged columns {clash} exist already")
    hidden = {c: f"__right_{i}" for i, c in enumerate(right.columns)}
    joined = equi_join(
        df, right.withColumnsRenamed(hidden), left_on, hidden[right_on], how, match_nulls, limits
    )
    # A row that only the right side has brings its key along.
    key = F.col(f"`{left_on}`")
    if shared and how in ("right", "outer"):
        key = F.coalesce(key, F.col(hidden[right_on]))
    return joined.select(
        *[key.alias(c) if c == left_on else F.col(f"`{c}`") for c in df.columns],
        *[F.col(hidden[c]).alias(n) for c, n in names.items()],
    )


def merge_report(
    df: DataFrame,
    right_table: str,
    left_on: str,
    right_on: str,
    tables: Mapping[str, DataFrame] | None = None,
    match_nulls: bool = True,
) -> DataFrame:
    """One row on what a merge would do, without doing it: which rows find a partner, and how many rows it adds.

    ``multiplied_rows`` are the rows beyond the first that left rows get because their key repeats on the right. Rows
    are counted per key on both sides first, so hot keys do not matter.
    """
    right = table(tables, right_table)
    need_column(df, left_on)
    need_column(right, right_on)
    same_key_type(df, left_on, right, right_on)
    ours = df.groupBy(F.col(f"`{left_on}`").alias("__left")).agg(F.count("*").alias("l"))
    theirs = right.groupBy(F.col(f"`{right_on}`").alias("__right")).agg(F.count("*").alias("r"))
    same = F.col("__left").eqNullSafe(F.col("__right")) if match_nulls else F.col("__left") == F.col("__right")
    rows = lambda n: F.coalesce(F.sum(n), F.lit(0))
    return ours.join(theirs, same, "outer").agg(
        rows("l").alias("left_rows"),
        rows("r").alias("right_rows"),
        rows(F.when(F.col("r").isNotNull(), F.col("l"))).alias("matched_left"),
        rows(F.when(F.col("r").isNull(), F.col("l"))).alias("unmatched_left"),
        rows(F.when(F.col("l").isNull(), F.col("r"))).alias("unmatched_right"),
        F.count_if((F.col("r") > 1) & F.col("l").isNotNull()).alias("repeated_keys"),
        rows(F.col("l") * (F.col("r") - 1)).alias("multiplied_rows"),
    )


def _parent_keys(
    df: DataFrame, child_column: str, parent_table: str, parent_column: str, tables: Mapping[str, DataFrame] | None
) -> DataFrame:
    parent = table(tables, parent_table)
    need_column(df, child_column)
    need_column(parent, parent_column)
    same_key_type(df, child_column, parent, parent_column)
    return parent.select(F.col(f"`{parent_column}`").alias("__parent")).where("__parent IS NOT NULL")


def fix_referential_integrity(
    df: DataFrame,
    child_column: str,
    parent_table: str,
    parent_column: str,
    action: str = "drop",
    tables: Mapping[str, DataFrame] | None = None,
    limits: JoinLimits = LIMITS,
) -> DataFrame:
    """Drop the rows whose key has no parent, or flag them in ``{child_column}_valid``. A null key has no parent."""
    need_choice("action", action, ("drop", "flag"))
    keys = _parent_keys(df, child_column, parent_table, parent_column, tables)
    if action == "drop":
        held = df.where(F.col(f"`{child_column}`").isNotNull())
        return lookup(held, keys, child_column, "__parent", "left_semi", limits=limits)
    flag = f"{child_column}_valid"
    marked = lookup(df.drop(flag), keys, child_column, "__parent", "left", limits=limits)
    return marked.withColumn(flag, F.col("__parent").isNotNull().cast("int")).drop("__parent")


def fk_violations(
    df: DataFrame,
    child_column: str,
    parent_table: str,
    parent_column: str,
    tables: Mapping[str, DataFrame] | None = None,
    limits: JoinLimits = LIMITS,
) -> DataFrame:
    """The rows whose key has no parent."""
    keys = _parent_keys(df, child_column, parent_table, parent_column, tables)
    return lookup(df, keys, child_column, "__parent", "left_anti", limits=limits)


def fk_counts(
    df: DataFrame,
    child_column: str,
    parent_table: str,
    parent_column: str,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One row: ``total_rows`` and ``valid_rows``. Rows are counted per key first, so hot keys do not matter."""
    keys = _parent_keys(df, child_column, parent_table, parent_column, tables)
    per_key = df.groupBy(F.col(f"`{child_column}`").alias("__child")).agg(F.count("*").alias("n"))
    marked = per_key.join(keys.distinct(), F.col("__child") == F.col("__parent"), "left")
    return marked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("__parent").isNotNull(), F.col("n"))), F.lit(0)).alias("valid_rows"),
    )
