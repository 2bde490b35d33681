"""Bringing the values of a column into one format."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import CleaningError, need_choice, need_column
from burnish.functions import formats
from burnish.functions.numbers import numeric, strip_currency
from burnish.functions.patterns import pattern as spark_pattern
from burnish.functions.patterns import replacement as spark_replacement
from burnish.functions.text import TEXT_OPERATIONS, standardize
from burnish.operators.stats import DATE_VOTES, Need, measure

FORMAT_TYPES = ("phone", "email", "date", "text_case", "strip_currency", "zip_code")
CASES = ("lower", "upper", "title")


def normalize_format(
    df: DataFrame,
    column: str,
    format_type: str,
    output_format: str | None = None,
    layouts: Sequence[str] = formats.DATE_LAYOUTS,
    by_column: bool = False,
    stats: Mapping[Need, object] | None = None,
) -> DataFrame:
    """Rewrite a column in the canonical spelling of ``format_type``; nulls stay null.

    ``output_format`` is a strftime format for dates (default ``%Y-%m-%d``) and the case for ``text_case``.
    With ``by_column`` the dates of the column that can be read in one order only decide whether those that can be read
    in two have their day or their month first.
    """
    need_column(df, column)
    need_choice("format_type", format_type, FORMAT_TYPES)
    kind, cell = df.schema[column].dataType, F.col(f"`{column}`")
    text = cell.cast("string")
    if format_type == "date":
        shape = formats.date_pattern(output_format or "%Y-%m-%d")
        is_time = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
        if not is_time:
            _need_layouts(df, layouts)
            if by_column:
                need = Need(column, DATE_VOTES)
                votes = stats[need] if stats and need in stats else measure(df, [need])[need]
                layouts = formats.voted_layouts(votes, layouts)
        when = cell if is_time else formats.parse_date(text, layouts)
        return df.withColumn(column, F.date_format(when, shape))
    if format_type == "text_case":
        case = (output_format or "lower").lower()
        need_choice("case", case, CASES)
        return df.withColumn(column, TEXT_OPERATIONS[case](text))
    if format_type == "strip_currency":
        return df.withColumn(column, strip_currency(cell) if isinstance(kind, T.StringType) else numeric(df, column))
    spell = {"phone": formats.phone, "email": formats.email, "zip_code": formats.zip_code}[format_type]
    return df.withColumn(column, spell(text))


def _need_layouts(df: DataFrame, layouts: Sequence[str]) -> None:
    """Refuse date layouts that Spark would refuse while the table is read."""
    if isinstance(layouts, str) or not all(isinstance(x, str) for x in layouts) or not layouts:
        raise CleaningError("layouts is a list of date patterns")
    strange = [x for x in layouts if x not in formats.DATE_LAYOUTS]
    if strange:
        try:
            df.sparkSession.range(1).select(formats.parse_date(F.lit("2024-01-02"), strange)).collect()
        except Exception as bad:
            raise CleaningError(f"unknown date layout among {strange}") from bad


def standardize_text(df: DataFrame, column: str, operations: Sequence[str]) -> DataFrame:
    """Apply text operations from left to right; an unknown one fails the whole step."""
    need_column(df, column)
    if isinstance(operations, str):
        raise CleaningError("operations is a list of names")
    return df.withColumn(column, standardize(F.col(f"`{column}`").cast("string"), list(operations)))


def apply_regex(df: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    """Replace every match of a pattern; pattern and replacement are written as for Python's ``re``."""
    need_column(df, column)
    text = F.col(f"`{column}`").cast("string")
    return df.withColumn(
        column, F.regexp_replace(text, F.lit(spark_pattern(pattern)), F.lit(spark_replacement(replacement, pattern)))
    )
