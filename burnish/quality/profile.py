"""What a table looks like and what is wrong with it.

All counts of a table come from one aggregate. Where duplicates are counted too, equal rows are combined first
and every other count is weighted by the number of copies, so the table is still read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import need_choice, need_column
from burnish.functions.formats import date_pattern
from burnish.functions.numbers import CURRENCY_PATTERN, numeric, present
from burnish.functions.patterns import pattern as spark_pattern
from burnish.functions.text import strip, title
from burnish.operators.ordered import sample_values
from burnish.operators.outliers import outlier_bounds
from burnish.operators.references import fk_counts
from burnish.operators.scratch import settled
from burnish.operators.stats import distinct_counts, duplicate_count

# Above this share of nulls a column's issue is severe.
HIGH_MISSING = 0.10
SEVERITIES = ("high", "medium", "low")
ISSUE_SCHEMA = "issue_type string, column string, severity string, description string, affected_rows bigint"
# Columns that should hold whole numbers.
WHOLE_COLUMNS = ("age",)
# The rule that text has no white space around it.
STRIPPED = "stripped"


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _is_float(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))


def _total(condition: Column) -> Column:
    return F.count_if(condition)


def _facts(
    df: DataFrame, duplicates: bool = False, pattern: str = CURRENCY_PATTERN, nulls: bool = True, currency: bool = True,
    whole: Sequence[str] = (),
) -> DataFrame:
    """One row: total and duplicate rows and, per column number, null, currency and fraction counts.

    Copies are counted apart, by hashes; the other counts need no shuffle of rows.
    """
    aggs = [F.count("*").alias("total")]
    if duplicates:
        aggs.append(duplicate_count(df).select("duplicate_rows").scalar().alias("copies"))
    for i, c in enumerate(df.columns):
        if nulls:
            aggs.append(_total(present(df, c).isNull()).alias(f"null{i}"))
        if currency and _is_text(df, c):
            aggs.append(_total(F.col(f"`{c}`").rlike(spark_pattern(pattern))).alias(f"money{i}"))
        if c in whole and _is_float(df, c):
            aggs.append(_total(numeric(df, c) % 1 != 0).alias(f"broken{i}"))
    return df.agg(*aggs)


def _issue(kind: str, column: str | None, severity: Column, description: Column, affected: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("issue_type"),
        F.lit(column).cast("string").alias("column"),
        severity.alias("severity"),
        description.alias("description"),
        affected.cast("bigint").alias("affected_rows"),
    )


def _issues(df: DataFrame, facts: DataFrame, found: list[Column]) -> DataFrame:
    """One row per issue that affects any row."""
    if not found:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    return facts.select(F.inline(F.array(*found))).where("affected_rows > 0")


# The kinds, severities and wording of issues here and below are those that users' rules look for.
def _missing_issue(i: int, column: str) -> Column:
    n, total = F.col(f"null{i}"), F.nullif(F.col("total"), F.lit(0))
    text = F.format_string("%d missing values (%.1f%%)", n, F.lit(100.0) * n / total)
    return _issue("missing_values", column, F.when(n / total > HIGH_MISSING, "high").otherwise("medium"), text, n)


def _copies_issue() -> Column:
    text = F.format_string("%d duplicate rows detected", F.col("copies"))
    return _issue("duplicate_rows", None, F.lit("medium"), text, F.col("copies"))


def _money_issue(i: int, column: str) -> Column:
    n = F.col(f"money{i}")
    text = F.concat(F.lit(f"'{column}' contains "), n.cast("string"), F.lit(" currency-formatted strings; expected numeric"))
    return _issue("wrong_dtype", column, F.lit("high"), text, n)


def detect_missing(df: DataFrame) -> DataFrame:
    """An issue per column with nulls; severe above a tenth of the rows."""
    return _issues(df, _facts(df, currency=False), [_missing_issue(i, c) for i, c in enumerate(df.columns)])


def detect_duplicates(df: DataFrame) -> DataFrame:
    """An issue if rows occur more than once."""
    return _issues(df, _facts(df, duplicates=True, nulls=False, currency=False), [_copies_issue()])


def detect_currency(df: DataFrame, pattern: str = CURRENCY_PATTERN) -> DataFrame:
    """An issue per text column with amounts of money; the default pattern also takes any comma for one."""
    money = [_money_issue(i, c) for i, c in enumerate(df.columns) if _is_text(df, c)]
    return _issues(df, _facts(df, nulls=False, pattern=pattern), money)


def detect_float_as_int(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """An issue per floating-point column that holds whole numbers only."""
    chosen = [c for c in (columns or df.columns) if c in df.columns and _is_float(df, c)]
    found = []
    for i, c in enumerate(df.columns):
        if c in chosen:
            held = F.col("total") - F.col(f"null{i}")
            whole = F.when(F.col(f"broken{i}") == 0, held).otherwise(F.lit(0))
            text = F.lit(f"'{c}' holds whole numbers stored as float")
            found.append(_issue("wrong_dtype", c, F.lit("medium"), text, whole))
    return _issues(df, _facts(df, currency=False, whole=chosen), found)


def detect_issues(df: DataFrame, pattern: str = CURRENCY_PATTERN) -> DataFrame:
    """Missing values, duplicate rows and currency text of a table, found in one pass."""
    missing = [_missing_issue(i, c) for i, c in enumerate(df.columns)]
    money = [_money_issue(i, c) for i, c in enumerate(df.columns) if _is_text(df, c)]
    return _issues(df, _facts(df, duplicates=True, pattern=pattern), [*missing, _copies_issue(), *money])


def top_issues(issues: DataFrame, n: int = 10) -> DataFrame:
    """The most severe issues, larger ones first."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return issues.orderBy(rank, F.desc("affected_rows"), F.asc_nulls_first("column"), "issue_type").limit(n)


def format_holds(df: DataFrame, column: str, rule: str) -> Column:
    """Whether a value follows a rule: ``title_case``, ``upper_case``, ``stripped``, a strftime format or a pattern."""
    text = F.col(f"`{column}`").cast("string")
    if rule == "title_case":
        return text == title(text)
    if rule == "upper_case":
        return text == F.upper(text)
    if rule == STRIPPED:
        return text == strip(text)
    if "%" in rule and not rule.startswith("^"):
        shape = date_pattern(rule)
        again = F.date_format(F.try_to_timestamp(text, F.lit(shape)), shape)
        return F.when(text.isNotNull(), F.coalesce(again == text, F.lit(False)))
    return text.rlike(spark_pattern(rule))


def detect_format_violation(df: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    """An issue per column with values that break its format rule; nulls break none."""
    rules = {c: r for c, r in formats.items() if c in df.columns}
    if not rules:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    facts = df.agg(*[F.count_if(~format_holds(df, c, r)).alias(f"bad{i}") for i, (c, r) in enumerate(rules.items())])
    found = [
        _issue(
            "format_violation", c, F.lit("medium"),
            F.format_string("%d values do not match the format", F.col(f"bad{i}")), F.col(f"bad{i}"),
        )
        for i, c in enumerate(rules)
    ]
    return _issues(df, facts, found)


def detect_padding(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """An issue per text column (or those named) with white space around its values."""
    need_column(df, *(columns or ()))
    return detect_format_violation(df, {c: STRIPPED for c in columns or df.columns if _is_text(df, c)})


def detect_outliers(df: DataFrame, columns: Sequence[str], threshold: float = 1.5, exact: bool = True) -> DataFrame:
    """An issue per column with numbers outside the quartile bounds."""
    need_column(df, *columns)
    bounds = {c: outlier_bounds(df, c, "iqr", threshold, exact=exact) for c in columns}
    known = {c: b for c, b in bounds.items() if b[0] is not None}
    if not known:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    facts = df.agg(*[F.count_if(~numeric(df, c).between(*known[c])).alias(f"out{i}") for i, c in enumerate(known)])
    found = [
        _issue(
            "outlier", c, F.lit("medium"),
            F.format_string("%d values outside the interquartile bounds", F.col(f"out{i}")), F.col(f"out{i}"),
        )
        for i, c in enumerate(known)
    ]
    return _issues(df, facts, found)


def detect_fk(
    df: DataFrame, child_column: str, parent_table: str, parent_column: str, tables: Mapping[str, DataFrame]
) -> DataFrame:
    """An issue if rows refer to keys that the parent table lacks."""
    counts = fk_counts(df, child_column, parent_table, parent_column, tables)
    bad = F.col("total_rows") - F.col("valid_rows")
    text = F.concat(bad.cast("string"), F.lit(f" rows have no match in {parent_table}.{parent_column}"))
    return _issues(df, counts, [_issue("referential_integrity", child_column, F.lit("high"), text, bad)])


def detect_schema_mismatch(df: DataFrame, target: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """An issue per column that the target schema has and the table lacks or holds in another type."""
    names = {
        "string": (T.StringType,), "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType), "bool": (T.BooleanType,),
        "int": (T.IntegralType,), "integer": (T.IntegralType,), "float": (T.DoubleType, T.FloatType, T.DecimalType),
    }
    found = []
    for column, want in target.items():
        kind = want["dtype"]
        need_choice("dtype", kind, names)
        if column not in df.columns:
            text = f"column is absent; expected {kind}"
        elif not isinstance(df.schema[column].dataType, names[kind]):
            text = f"type is {df.schema[column].dataType.simpleString()}; expected {kind}"
        else:
            continue
        found.append(_issue("schema_mismatch", column, F.lit("high"), F.lit(text), F.col("total")))
    return _issues(df, df.agg(F.count("*").alias("total")), found)


def column_profile(
    df: DataFrame,
    order_by: Sequence[str],
    approx: bool = False,
    pattern: str = CURRENCY_PATTERN,
    whole_columns: Sequence[str] = WHOLE_COLUMNS,
) -> DataFrame:
    """One row per column: position, type, nulls, different values, first values and detected issues.

    Every column is read on its own, so a table with a shuffle before it is written once first.
    """
    df = settled(df)
    facts = _facts(df, pattern=pattern, whole=whole_columns)
    rows = []
    for i, c in enumerate(df.columns):
        n, total = F.col(f"null{i}"), F.col("total")
        share = F.coalesce(F.round(F.lit(100.0) * n / F.nullif(total, F.lit(0)), 2), F.lit(0.0))
        notes = [F.when(n > 0, F.format_string("missing_values (%d nulls, %.1f%%)", n, share))]
        if _is_text(df, c):
            notes.append(F.when(F.col(f"money{i}") > 0, F.lit("currency_string — should be numeric")))
        if c in whole_columns and _is_float(df, c):
            notes.append(F.when(F.col(f"broken{i}") == 0, F.lit("stored_as_float — should be int")))
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                n.cast("bigint").alias("null_count"),
                share.alias("null_pct"),
                F.array_compact(F.array(*notes)).alias("detected_issues"),
            )
        )
    basis = facts.select(F.inline(F.array(*rows)))
    merged = basis.join(distinct_counts(df, approx), "column_name", "left").join(
        sample_values(df, order_by), "column_name", "left"
    )
    return merged.select(
        "position", "column_name", "dtype", "null_count", "null_pct",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "sample_values", "detected_issues",
    )


def dataset_stats(
    df: DataFrame, pattern: str = CURRENCY_PATTERN, whole_columns: Sequence[str] = WHOLE_COLUMNS
) -> DataFrame:
    """One row of totals: rows, columns, missing cells, duplicate rows, columns of the wrong type."""
    facts = _facts(df, duplicates=True, pattern=pattern)
    missing = sum((F.col(f"null{i}") for i in range(len(df.columns))), F.lit(0))
    text = [F.when(F.col(f"money{i}") > 0, 1).otherwise(0) for i, c in enumerate(df.columns) if _is_text(df, c)]
    floats = sum(1 for c in df.columns if c in whole_columns and _is_float(df, c))
    wrong = sum(text, F.lit(floats)).cast("bigint")
    cells = F.col("total") * len(df.columns)
    return facts.select(
        F.col("total").alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_cols"),
        missing.cast("bigint").alias("missing_cells"),
        F.coalesce(F.round(F.lit(100.0) * missing / F.nullif(cells, F.lit(0)), 2), F.lit(0.0)).alias("missing_pct"),
        F.col("copies").alias("duplicate_rows"),
        wrong.alias("dtype_issues"),
        wrong.alias("format_violations"),
    )
