"""Codes for labels that stay as they are when new labels arrive.

A dictionary is a table (label, code). It only grows: labels it lacks get the codes after its largest one, in ascending
order, so whatever was encoded before keeps its meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.errors import CleaningError, need_choice, need_column
from burnish.operators.joining import LIMITS, JoinLimits, equi_join
from burnish.operators.ordered import ranked_values
from burnish.operators.scratch import settle

ON_NEW = ("null", "fail")
_LABEL, _CODE = "__label", "__code"


def new_labels(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """Rows (label, code) for the labels of a column that the dictionary ``known`` lacks. Nulls are no labels.

    Rows meet the dictionary only after they were reduced to different labels.
    """
    need_column(df, column)
    labels = df.select(F.col(f"`{column}`").cast("string").alias("label")).where("label IS NOT NULL").distinct()
    if known is None:
        return ranked_values(settle(labels), "label", "code")
    need_column(known, "label", "code")
    first = known.agg(F.coalesce(F.max("code") + 1, F.lit(0))).first()[0]
    absent = settle(labels.join(known.select("label"), "label", "left_anti"))
    return ranked_values(absent, "label", "code").withColumn("code", F.col("code") + F.lit(first).cast("long"))


def extend_dictionary(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """The dictionary ``known``, if any, with the new labels of a column."""
    added = new_labels(df, column, known)
    return added if known is None else known.select("label", F.col("code").cast("long").alias("code")).unionByName(added)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame | None:
    """The dictionary in a folder, if it has one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema("label string, code bigint").parquet(path) if there else None


def append_dictionary(df: DataFrame, column: str, path: str) -> DataFrame:
    """Add the new labels of a column to the dictionary in a folder, which nothing else may write meanwhile.

    Only new labels are written. If a write is cut off, a later one numbers what it left out after what it added, so
    codes may have gaps, but no label ever gets a second code.
    """
    spark = df.sparkSession
    new_labels(df, column, load_dictionary(spark, path)).write.mode("append").parquet(path)
    return load_dictionary(spark, path)


def encode(
    df: DataFrame, column: str, dictionary: DataFrame, code: str | None = None, on_new: str = "null",
    limits: JoinLimits = LIMITS,
) -> DataFrame:
    """``df`` with the codes of a column's labels in ``code`` (``{column}_code``).

    Null stays null. A label that the dictionary lacks gives null too, or fails the action that reads the result.
    """
    need_column(df, column)
    need_choice("on_new", on_new, ON_NEW)
    code = _free_name(df, code or f"{column}_code")
    labelled = df.withColumn(_LABEL, F.col(f"`{column}`").cast("string"))
    pairs = dictionary.select(F.col("label").alias("__known"), F.col("code").alias(_CODE))
    joined = equi_join(labelled, pairs, _LABEL, "__known", "left", False, limits)
    found = F.col(_CODE)
    if on_new == "fail":
        lost = F.raise_error(F.concat(F.lit(f"no code for a label of {column!r}: "), F.col(_LABEL)))
        found = F.when(found.isNotNull() | F.col(_LABEL).isNull(), found).otherwise(lost.cast("long"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], found.alias(code))


def decode(
    df: DataFrame, code: str, dictionary: DataFrame, column: str = "label", limits: JoinLimits = LIMITS
) -> DataFrame:
    """``df`` with the labels of the codes in ``code``; null where the dictionary lacks the code."""
    need_column(df, code)
    column = _free_name(df, column)
    pairs = dictionary.select(F.col("code").alias(_CODE), F.col("label").alias(_LABEL))
    joined = equi_join(df, pairs, code, _CODE, "left", False, limits)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.col(_LABEL).alias(column))


def _free_name(df: DataFrame, name: str) -> str:
    if name in df.columns:
        raise CleaningError(f"column {name!r} exists already")
    return name
