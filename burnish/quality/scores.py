"""Quality scores in [0, 1]: single measures, and weighted scorecards of them.

Measures are aggregates, so a scorecard reads its table once, and once more where duplicates count: these are found by
hashes of rows, apart from the other measures.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.errors import CleaningError
from burnish.functions.numbers import CURRENCY_PATTERN, numeric
from burnish.functions.patterns import pattern as spark_pattern
from burnish.functions.text import strip, title
from burnish.operators.missing import present
from burnish.operators.references import fk_counts
from burnish.operators.stats import MAX, MIN, QUARTILES, Need, duplicate_count, fraction, measure
from burnish.quality.regression import downstream_r2

# The weights of the scorecards, the patterns of clean contact data and the decimals of a measure.
CUSTOMER_WEIGHTS = {"completeness": 0.30, "type_correctness": 0.30, "deduplication": 0.20, "format_consistency": 0.20}
CONTACT_PATTERNS = {
    "phone": r"^\(\d{3}\) \d{3}-\d{4}$",
    "email": r"^[a-z0-9_.+\-]+@[a-z0-9\-]+\.[a-z]{2,}$",
    "birth_date": r"^\d{4}-\d{2}-\d{2}$",
    "zip_code": r"^\d{5}$",
    "country": r"^[A-Z]{2,3}$",
}
CONTACT_WEIGHTS = {
    "phone": 0.20, "email": 0.20, "birth_date": 0.20, "zip_code": 0.15, "country": 0.10, "name_case": 0.15,
}
ORDER_WEIGHTS = {"referential_integrity": 0.30, "deduplication": 0.20, "outlier_removal": 0.20, "downstream_ml": 0.30}
ORDER_CONTENT = ("customer_id", "product", "price", "quantity", "order_date")
DECIMALS = 4
FENCE = 1.5


def mean_of(parts: Sequence[Column], empty: float = 0.0) -> Column:
    """The plain mean of several scores."""
    return sum(parts[1:], parts[0]) / F.lit(float(len(parts))) if parts else F.lit(empty)


def completeness(df: DataFrame, columns: Sequence[str], weight: Column | None = None) -> Column:
    """The share of non-null cells in those of the columns that exist."""
    here = [c for c in columns if c in df.columns]
    return mean_of([fraction(present(df, c).isNotNull(), weight=weight) for c in here])


def currency_numeric(df: DataFrame, column: str, weight: Column | None = None) -> Column:
    """Half for being a number, half for holding no currency symbol; over all rows."""
    symbol = F.coalesce(F.col(f"`{column}`").cast("string").rlike(spark_pattern(CURRENCY_PATTERN)), F.lit(False))
    return mean_of([fraction(numeric(df, column).isNotNull(), weight=weight), fraction(~symbol, weight=weight)])


def integer_type(df: DataFrame, column: str, weight: Column | None = None) -> Column:
    """Half for being a number (over all rows), half for numbers being whole (over the numbers)."""
    number = numeric(df, column)
    return mean_of([fraction(number.isNotNull(), weight=weight), fraction(number % 1 == 0, number.isNotNull(), weight)])


def type_correctness(df: DataFrame, money: str = "salary", count: str = "age", weight: Column | None = None) -> Column:
    """The mean of the money and whole-number measures of the columns that exist."""
    parts = [currency_numeric(df, money, weight)] if money in df.columns else []
    return mean_of(parts + ([integer_type(df, count, weight)] if count in df.columns else []))


def title_case(df: DataFrame, column: str, weight: Column | None = None) -> Column:
    """The share of values that equal their title form."""
    text = F.col(f"`{column}`").cast("string")
    return fraction(text == title(text), text.isNotNull(), weight)


def stripped(df: DataFrame, column: str, weight: Column | None = None) -> Column:
    """The share of values without white space at the ends."""
    text = F.col(f"`{column}`").cast("string")
    return fraction(text == strip(text), text.isNotNull(), weight)


def matches(df: DataFrame, column: str, pattern: str, weight: Column | None = None) -> Column:
    """The share of values that match a pattern; 0 if the column is absent or empty."""
    if column not in df.columns:
        return F.lit(0.0)
    text = F.col(f"`{column}`").cast("string")
    return fraction(text.rlike(spark_pattern(pattern)), text.isNotNull(), weight)


def score(df: DataFrame, name: str, aggregate: Column) -> DataFrame:
    """One row with one measure, rounded."""
    return df.agg(F.round(aggregate, DECIMALS).alias(name))


def score_dedup(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: 1 minus the share of rows that repeat an earlier one; 0 for an empty table."""
    return _single_share(df, subset).select(F.round("deduplication", DECIMALS).alias("deduplication"))


def _single_share(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    counts = duplicate_count(df, subset)
    share = F.coalesce(1 - F.col("duplicate_rows") / F.nullif(F.col("total_rows"), F.lit(0)), F.lit(0.0))
    return counts.select(share.alias("deduplication"))


def score_fk(
    df: DataFrame, child_column: str, parent_table: str, parent_column: str, tables: Mapping[str, DataFrame]
) -> DataFrame:
    """One row: the share of rows whose key the parent table has; 0 for an empty table."""
    counts = fk_counts(df, child_column, parent_table, parent_column, tables)
    share = F.coalesce(F.col("valid_rows") / F.nullif(F.col("total_rows"), F.lit(0)), F.lit(0.0))
    return counts.select(F.round(share, DECIMALS).alias("referential_integrity"))


def outlier_reference(
    original: DataFrame, columns: Sequence[str] = ("price", "quantity"), exact: bool = True
) -> dict[Need, object]:
    """What a table is compared with to tell how well its outliers were removed; worth keeping between scores."""
    here = [c for c in columns if c in original.columns]
    return measure(original, [Need(c, k) for c in here for k in (QUARTILES, MIN, MAX)], exact)


def score_outlier_removal(
    df: DataFrame, original: DataFrame | Mapping[Need, object], columns: Sequence[str] = ("price", "quantity")
) -> DataFrame:
    """One row: how far the extremes beyond the original's quartile bounds were pulled in.

    Per column the excess above and below is compared with that of the original (a table, or its reference);
    0.5 if nothing can be compared.
    """
    reference = outlier_reference(original, columns) if isinstance(original, DataFrame) else original
    parts = []
    for c in columns:
        low, high = reference.get(Need(c, QUARTILES), (None, None))
        if c not in df.columns or low is None:
            continue
        top, bottom = high + FENCE * (high - low), low - FENCE * (high - low)
        number = numeric(df, c)
        above = _tamed(F.max(number) - F.lit(top), reference[Need(c, MAX)] - top)
        below = _tamed(F.lit(bottom) - F.min(number), bottom - reference[Need(c, MIN)])
        parts.append(F.when(F.count(number) > 0, (above + below) / 2))
    if not parts:
        return df.agg(F.lit(0.5).alias("outlier_removal"))
    known = F.array_compact(F.array(*parts))
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    value = F.when(F.size(known) > 0, total / F.size(known)).otherwise(F.lit(0.5))
    return df.agg(F.round(value, DECIMALS).alias("outlier_removal"))


def _tamed(excess: Column, original_excess: float) -> Column:
    """1 minus the ratio of the excesses, within [0, 1]; 1 if there was none."""
    if original_excess <= 0:
        return F.lit(1.0)
    left = F.greatest(excess, F.lit(0.0)) / F.lit(float(original_excess))
    return F.least(F.greatest(1 - left, F.lit(0.0)), F.lit(1.0))


def _card(row: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Round the components of a one-row table and add their weighted sum."""
    rounded = row.select(*[F.round(c, DECIMALS).alias(c) for c in weights])
    overall = sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return rounded.withColumn("overall", F.greatest(F.least(overall, F.lit(1.0)), F.lit(0.0)))


def scorecard_customers(df: DataFrame) -> DataFrame:
    """One row: completeness, types, duplicates and format of a table of people, and their weighted sum."""
    names = [title_case(df, "name")] if "name" in df.columns else []
    formats = names + ([stripped(df, "department")] if "department" in df.columns else [])
    row = df.agg(
        completeness(df, ("age", "salary", "email")).alias("completeness"),
        type_correctness(df).alias("type_correctness"),
        _single_share(df).scalar().alias("deduplication"),
        mean_of(formats).alias("format_consistency"),
    )
    return _card(row, CUSTOMER_WEIGHTS)


def scorecard_contacts(df: DataFrame) -> DataFrame:
    """One row: the shares of well-formed contact values and of title-cased names, and their weighted sum."""
    held = [c for c in ("first_name", "last_name") if c in df.columns]
    counts = [F.when(F.count(f"`{c}`") > 0, 1).otherwise(0) for c in held]
    named = sum((title_case(df, c) for c in held), F.lit(0.0)) / F.nullif(sum(counts, F.lit(0)), F.lit(0))
    row = df.agg(
        *[matches(df, c, p).alias(c) for c, p in CONTACT_PATTERNS.items()],
        F.coalesce(named, F.lit(0.0)).alias("name_case"),
    )
    return _card(row, CONTACT_WEIGHTS)


def scorecard_orders(
    df: DataFrame, customers: DataFrame, original: DataFrame | Mapping[Need, object]
) -> DataFrame:
    """One row: references, duplicates, outliers and fit of a table of orders, and their weighted sum."""
    linked = "customer_id" in df.columns and "customer_id" in customers.columns
    content = [c for c in ORDER_CONTENT if c in df.columns]
    parts = {
        "referential_integrity": score_fk(df, "customer_id", "customers", "customer_id", {"customers": customers}).scalar()
        if linked
        else F.lit(0.0),
        "deduplication": score_dedup(df, content).scalar() if content else F.lit(0.0),
        "downstream_ml": F.lit(downstream_r2(df)),
    }
    row = score_outlier_removal(df, original)
    return _card(row.select("outlier_removal", *[v.alias(k) for k, v in parts.items()]), ORDER_WEIGHTS)


def breakdown(card: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Rows (component, weight, score, weighted) of a scorecard's one row."""
    found = [
        F.struct(F.lit(c).alias("component"), F.lit(float(w)).alias("weight"), F.col(c).alias("score"), (F.lit(float(w)) * F.col(c)).alias("weighted"))
        for c, w in weights.items()
    ]
    return card.select(F.inline(F.array(*found)))


def scorecard_generic(df: DataFrame, components: Mapping[str, tuple[float, Column | DataFrame]]) -> DataFrame:
    """Rows (component, weight, score, weighted) for measures of the caller's choice.

    Aggregates are taken in one pass. A measure may also be a table of one row and column, such as ``score_dedup`` or
    ``score_fk`` give.
    """
    if not components:
        raise CleaningError("a scorecard needs at least one component")
    wide = [name for name, (_, m) in components.items() if isinstance(m, DataFrame) and len(m.columns) != 1]
    if wide:
        raise CleaningError(f"measures {wide} are tables of more than one column")
    measures = [m.scalar() if isinstance(m, DataFrame) else m for _, m in components.values()]
    row = df.agg(*[F.round(m, DECIMALS).alias(f"m{i}") for i, m in enumerate(measures)])
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("component"),
                        F.lit(float(weight)).alias("weight"),
                        F.col(f"m{i}").alias("score"),
                        (F.lit(float(weight)) * F.col(f"m{i}")).alias("weighted"),
                    )
                    for i, (name, (weight, _)) in enumerate(components.items())
                ]
            )
        )
    )

