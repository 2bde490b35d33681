"""From the issues of a table to the steps that mend them."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.quality.profile import STRIPPED

# Which of the known formats a column of this name is brought into.
FORMAT_OF_COLUMN = {"phone": "phone", "email": "email", "zip_code": "zip_code", "birth_date": "date"}
FILL_TEXT = "unknown"


def recommend_actions(
    issues: DataFrame,
    df: DataFrame,
    formats: Mapping[str, str] | None = None,
    parents: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Rows (priority, action_type, column, parameters): one step per issue, in the order in which to run them.

    ``formats`` are the format rules that were checked, ``parents`` the (table, column) a key column refers to.
    References come first, then copies, types, formats, gaps and outliers.
    """
    column = F.col("column")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    padded = [c for c, rule in (formats or {}).items() if rule == STRIPPED]
    # Whether any issue of the column is money in text; the issues, a few per column, are computed once.
    money = F.bool_or((F.col("issue_type") == "wrong_dtype") & column.isin(texts)).over(Window.partitionBy("column"))
    marked = issues.withColumn("money", F.coalesce(money, F.lit(False)))

    by_number = column.isin(numbers) | F.col("money")
    median = _parameters(column=column, strategy=F.lit("median"))
    constant = _parameters(column=column, strategy=F.lit("constant"), fill_value=F.lit(FILL_TEXT))
    frequent = _parameters(column=column, strategy=F.lit("mode"))
    fill = F.when(by_number, median).when(column.isin(texts), constant).otherwise(frequent)

    kind = F.col("issue_type")
    rules = [
        (1, kind == "referential_integrity", "fix_referential_integrity", _by_column(parents or {}, _reference)),
        (2, kind == "duplicate_rows", "drop_duplicates", F.lit("{}")),
        (3, (kind == "wrong_dtype") & column.isin(texts), "normalize_format",
         _parameters(column=column, format_type=F.lit("strip_currency"))),
        (4, (kind == "format_violation") & column.isin(padded), "standardize_text",
         _parameters(column=column, operations=F.array(F.lit("strip")))),
        (4, kind == "format_violation", "normalize_format", _by_column(formats or {}, _format)),
        (5, kind == "missing_values", "fill_missing", fill),
        (6, (kind == "wrong_dtype") & column.isin(numbers), "cast_column",
         _parameters(column=column, dtype=F.lit("int"))),
        (7, kind == "outlier", "clip_outliers", _parameters(column=column, method=F.lit("iqr"))),
    ]
    steps = [
        F.when(holds, F.struct(F.lit(i).alias("priority"), F.lit(a).alias("action_type"), "column", p.alias("parameters")))
        for i, holds, a, p in rules
    ]
    return marked.select(F.inline(F.array(F.coalesce(*steps)))).where("parameters IS NOT NULL")


def steps_of(recommended: DataFrame) -> list[dict[str, object]]:
    """The recommended steps as a plan; there are at most a few per column."""
    rows = recommended.orderBy("priority", "column").collect()
    return [{"action_type": r["action_type"], "parameters": json.loads(r["parameters"])} for r in rows]


def _parameters(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))


def _by_column(options: Mapping[str, object], build: object) -> Column:
    """A JSON object that depends on the column's name; null where there is no rule for it."""
    found = [F.when(F.col("column") == c, F.lit(build(c, o))) for c, o in options.items()]  # type: ignore[operator]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _reference(column: str, parent: tuple[str, str]) -> str:
    return json.dumps({"child_column": column, "parent_table": parent[0], "parent_column": parent[1], "action": "drop"})


def _format(column: str, rule: str) -> str | None:
    if rule in ("title_case", "upper_case"):
        return json.dumps({"column": column, "format_type": "text_case", "output_format": rule.removesuffix("_case")})
    known = FORMAT_OF_COLUMN.get(column)
    return json.dumps({"column": column, "format_type": known}) if known else None
