"""Loading named tables, looking at them, and writing cleaned ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import CleaningError, need_choice
from burnish.functions.numbers import nan_to_null
from burnish.operators.ordered import head_rows

FORMATS = ("parquet", "orc", "csv", "json")
MODES = ("errorifexists", "overwrite", "append", "ignore")


def load_tables(
    spark: SparkSession,
    paths: Mapping[str, str],
    format: str = "parquet",
    schemas: Mapping[str, T.StructType | str] | None = None,
    options: Mapping[str, str] | None = None,
    nan_as_null: bool = True,
) -> dict[str, DataFrame]:
    """Tables by name. CSV and JSON need a schema, as guessing one reads all data.

    NaN becomes null, which keeps scans from filtering on floating-point columns; for tables known to hold
    no NaN it can be left out.
    """
    need_choice("format", format, FORMATS)
    loaded = {}
    for name, path in paths.items():
        reader = spark.read.format(format).options(**dict(options or {}))
        schema = (schemas or {}).get(name)
        if schema is None and format in ("csv", "json"):
            raise CleaningError(f"table {name!r}: pass a schema for {format}")
        df = (reader.schema(schema) if schema else reader).load(path)
        loaded[name] = without_nan(df) if nan_as_null else df
    return loaded


def without_nan(df: DataFrame) -> DataFrame:
    """Real nulls instead of NaN in all floating-point columns."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats}) if floats else df


def preview_aux(df: DataFrame, order_by: Sequence[str], n: int = 3) -> DataFrame:
    """The first rows of an auxiliary table, each with the table's number of rows in ``total_rows``."""
    total = df.agg(F.count("*").alias("total_rows")).scalar()
    return head_rows(df, order_by, n).withColumn("total_rows", total)


def write_clean(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    format: str = "parquet",
) -> None:
    """Write a cleaned table, an issue list or an audit record."""
    need_choice("mode", mode, MODES)
    need_choice("format", format, FORMATS)
    df.write.format(format).mode(mode).partitionBy(*partition_by).save(path)
