"""What type the values of a column have, whatever type the column is stored in.

Each value has a bit for every type it can be read as. The bits that all values share, joined by ``bit_and`` in one
aggregate, are the types that hold the column; as ``bit_and`` neither minds order nor grouping, the masks of the parts
of a table merge to those of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import need_column
from burnish.functions.formats import is_date
from burnish.functions.numbers import numeric, present, strip_currency
from burnish.functions.text import strip

# From the narrowest type to the widest one; a column gets the first that holds all its values.
VALUE_TYPES = ("int", "float", "money", "datetime", "bool", "text")
# The words that mean true or false. Digits are numbers.
TRUTH_WORDS = ("true", "false", "yes", "no", "t", "f", "y", "n")
#: of a column without values: every type holds it
ANY = (1 << len(VALUE_TYPES)) - 1

# Whole numbers beyond it cannot be told from fractions in a double.
_MOST_EXACT = float(2**53)


def _tests(df: DataFrame, column: str) -> dict[str, Column]:
    """What a value can be read as, by type; those of text start from ``number``, what it is as a number."""
    kind, value = df.schema[column].dataType, present(df, column)
    if isinstance(kind, T.StringType):
        return {
            "number": numeric(df, column), "money": strip_currency(value).isNotNull(),
            "datetime": is_date(value), "bool": F.lower(strip(value)).isin(*TRUTH_WORDS),
        }
    if isinstance(kind, T.IntegralType):
        return dict.fromkeys(("int", "float", "money"), F.lit(True))
    if isinstance(kind, T.NumericType):
        return {"number": value.cast("double"), "money": F.lit(True)}
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {"datetime": F.lit(True)}
    return {"bool": F.lit(True)} if isinstance(kind, T.BooleanType) else {}


def _mask(cell: str, names: Sequence[str]) -> Column:
    """The types that a value can be read as, one bit each; null for a missing value."""
    holds = {n: F.col(f"{cell}.{n}") for n in names} | {"text": F.lit(True)}
    if "number" in holds:
        number = holds["number"]
        holds |= {"float": number.isNotNull(), "int": (number % 1 == 0) & (F.abs(number) <= _MOST_EXACT)}
    bits = [F.when(holds[n], F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(VALUE_TYPES) if n in holds]
    return F.when(F.col(f"{cell}.held"), reduce(Column.bitwiseOR, bits))


def type_masks(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (column_name, stored_type, values, type_mask), one per column, from one pass without a shuffle of rows."""
    chosen = list(columns or df.columns)
    need_column(df, *chosen)
    tests = [_tests(df, c) for c in chosen]
    # The tests are columns of their own, so that each is taken once per value.
    tested = df.select(*[
        F.struct(present(df, c).isNotNull().alias("held"), *[x.alias(n) for n, x in tests[i].items()]).alias(f"c{i}")
        for i, c in enumerate(chosen)
    ])
    masks = tested.select(*[_mask(f"c{i}", list(names)).alias(f"m{i}") for i, names in enumerate(tests)])
    aggregates = [a for i in range(len(chosen)) for a in (F.bit_and(f"m{i}").alias(f"m{i}"), F.count(f"m{i}").alias(f"n{i}"))]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("stored_type"),
            F.col(f"n{i}").alias("values"),
            F.coalesce(f"m{i}", F.lit(ANY)).alias("type_mask"),
        )
        for i, c in enumerate(chosen)
    ]
    return masks.agg(*aggregates).select(F.inline(F.array(*rows)))


def merge_masks(*parts: DataFrame) -> DataFrame:
    """The masks of a whole table from those of its parts."""
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together.groupBy("column_name", "stored_type").agg(
        F.sum("values").alias("values"), F.bit_and("type_mask").alias("type_mask")
    )


def value_types(masks: DataFrame) -> DataFrame:
    """Rows (column_name, stored_type, values, value_type): the narrowest type that holds all values, null without any."""
    found = F.coalesce(*[
        F.when(F.col("type_mask").bitwiseAND(F.lit(1 << place)) != 0, F.lit(name)) for place, name in enumerate(VALUE_TYPES)
    ])
    return masks.select("column_name", "stored_type", "values", F.when(F.col("values") > 0, found).alias("value_type"))


def detect_value_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The type of the values of each column, or of those named."""
    return value_types(type_masks(df, columns))


def type_steps(types: DataFrame) -> list[dict[str, object]]:
    """The steps that bring columns into the type of their values; there is at most one per column."""
    casts = {"int": "int", "float": "float", "datetime": "datetime", "bool": "bool"}
    steps: list[dict[str, object]] = []
    for row in types.where("value_type IS NOT NULL").orderBy("column_name").collect():
        column, stored, held = row["column_name"], row["stored_type"], row["value_type"]
        if stored == "string" and held == "money":
            steps.append({"action_type": "normalize_format", "parameters": {"column": column, "format_type": "strip_currency"}})
        elif (stored == "string" and held in casts) or (stored in ("double", "float") and held == "int"):
            steps.append({"action_type": "cast_column", "parameters": {"column": column, "dtype": casts[held]}})
    return steps
