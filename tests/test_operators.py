"""Operators on literal tables: nulls, NaN, empty tables, and refusals."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from burnish.errors import CleaningError
from burnish.operators.columns import cast_column, drop_column, rename_column, select_columns
from burnish.operators.formats import apply_regex, normalize_format, standardize_text
from burnish.operators.missing import fill_missing
from burnish.operators.outliers import clip_outliers
from burnish.operators.references import fix_referential_integrity, fk_violations, merge_tables
from burnish.operators.rows import drop_duplicates, drop_rows_by_condition, union_all
from burnish.operators.stats import (
    MEAN,
    MEDIAN,
    QUARTILES,
    STD,
    WHOLE,
    Need,
    distinct_counts,
    duplicate_count,
    measure,
    mode,
    null_counts,
)

NAN = float("nan")


def column(df, name="x"):
    return sorted((r[name] for r in df.collect()), key=lambda v: (v is not None, v))


def table(spark, values, kind="double", name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


# --- dropping rows --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("operator", "value", "left"),
    [
        ("==", 1.0, [None, 2.0]), ("!=", 1.0, [1.0]), (">", 1, [None, 1.0]), ("<", 2, [None, 2.0]), (">=", "2", [None, 1.0]),
        ("<=", 1, [None, 2.0]), ("isnull", None, [1.0, 2.0]), ("notnull", None, [None]), ("contains", r"^1", [None, 2.0]),
    ],
)
def test_polarity_and_nulls(spark, operator, value, left):
    df = table(spark, [1.0, 2.0, None])
    assert column(drop_rows_by_condition(df, "x", operator, value)) == left


def test_nan_is_no_number(spark):
    df = table(spark, [1.0, NAN])
    assert drop_rows_by_condition(df, "x", ">", 0).count() == 1
    assert drop_rows_by_condition(df, "x", "<", 2).count() == 1


def test_text_never_equals_a_number(spark):
    df = table(spark, ["1", "2", None], "string")
    assert drop_rows_by_condition(df, "x", "==", 1).count() == 3
    assert drop_rows_by_condition(df, "x", "!=", 1).count() == 0
    assert column(drop_rows_by_condition(df, "x", ">", 1)) == [None, "1"]


def test_refused_conditions(spark):
    df = table(spark, [1.0])
    for args in (("y", "==", 1), ("x", "~", 1), ("x", ">", "many"), ("x", "contains", "("), ("x", "==", None)):
        with pytest.raises(CleaningError):
            drop_rows_by_condition(df, *args)


# --- columns --------------------------------------------------------------------------------------------------


def test_rename_drop_select(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rename_column(df, "a", "c").columns == ["c", "b"]
    assert drop_column(df, "a").columns == ["b"]
    assert select_columns(df, "b", ["z", "a", "b"]).columns == ["b", "a"]
    for bad in (lambda: rename_column(df, "z", "c"), lambda: rename_column(df, "a", "b"), lambda: drop_column(df, "z")):
        with pytest.raises(CleaningError):
            bad()


def test_int_cast(spark):
    assert column(cast_column(table(spark, [34.0, None, NAN]), "x", "int")) == [None, None, 34]
    assert column(cast_column(table(spark, ["x", " 7 ", "1e2"], "string"), "x", "integer")) == [None, 7, 100]
    with pytest.raises(CleaningError):
        cast_column(table(spark, [34.5]), "x", "int")
    assert column(cast_column(table(spark, [34.5, 2.0]), "x", "int", on_fraction="null")) == [None, 2]
    assert column(cast_column(table(spark, [34.5, 2.0]), "x", "int", on_fraction="round")) == [2, 35]
    assert cast_column(table(spark, [1.0]), "x", "int").schema["x"].dataType.simpleString() == "bigint"


def test_other_casts(spark):
    assert column(cast_column(table(spark, ["true", "no", "what", None], "string"), "x", "bool")) == [None, None, False, True]
    assert column(cast_column(table(spark, [0.0, 2.0, None]), "x", "bool")) == [None, False, True]
    assert column(cast_column(table(spark, [1, None], "int"), "x", "str")) == [None, "1"]
    assert column(cast_column(table(spark, ["a", None], "string"), "x", "category")) == [None, "a"]
    assert column(cast_column(table(spark, ["1", "1d"], "string"), "x", "float")) == [None, 1.0]
    day = datetime.date(2020, 1, 2)
    assert column(cast_column(table(spark, [day], "date"), "x", "datetime")) == [datetime.datetime(2020, 1, 2)]
    assert column(cast_column(table(spark, [day], "date"), "x", "float")) == [None]
    with pytest.raises(CleaningError):
        cast_column(table(spark, [1.0]), "x", "complex")


# --- missing values -------------------------------------------------------------------------------------------


def test_fills(spark):
    df = table(spark, [1.0, 2.0, 6.0, None, NAN])
    assert column(fill_missing(df, "x", "mean")) == [1.0, 2.0, 3.0, 3.0, 6.0]
    assert column(fill_missing(df, "x", "median")) == [1.0, 2.0, 2.0, 2.0, 6.0]
    assert column(fill_missing(df, "x", "constant", 9)) == [1.0, 2.0, 6.0, 9.0, 9.0]
    assert column(fill_missing(df, "x", "drop")) == [1.0, 2.0, 6.0]
    assert column(fill_missing(df, "x", "unknown")) == ["1.0", "2.0", "6.0", "unknown", "unknown"]
    assert column(fill_missing(table(spark, [2, 1, 2, 1, 3, None], "int"), "x", "mode")) == [1, 1, 1, 2, 2, 3]


def test_fill_without_any_value(spark):
    df = table(spark, [None, None])
    for strategy in ("mean", "median", "mode"):
        assert column(fill_missing(df, "x", strategy)) == [None, None]


def test_fill_of_whole_numbers(spark):
    whole = fill_missing(table(spark, [1, 3, None], "bigint"), "x", "mean")
    assert whole.schema["x"].dataType.simpleString() == "bigint" and column(whole) == [1, 2, 3]
    broken = fill_missing(table(spark, [1, 2, None], "bigint"), "x", "mean")
    assert broken.schema["x"].dataType.simpleString() == "double" and column(broken) == [1.0, 1.5, 2.0]


def test_fill_keeps_the_type(spark):
    df = table(spark, [1, None], "int")
    with pytest.raises(CleaningError):
        fill_missing(df, "x", "constant", "none")
    assert column(fill_missing(df, "x", "constant", "none", cast_to_string=True)) == ["1", "none"]
    for bad in ({"strategy": "constant"}, {"strategy": "magic"}, {"strategy": "forward_fill"}):
        with pytest.raises(CleaningError):
            fill_missing(df, "x", **bad)


def test_forward_and_backward(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", 5), (3, "b", None), (4, "a", None), (5, "b", 7), (6, "a", None)], "i int, g string, x int"
    )
    run = lambda strategy, **kw: [r["x"] for r in fill_missing(df, "x", strategy, order_by=["i"], **kw).orderBy("i").collect()]
    assert run("forward_fill") == [None, 5, 5, 5, 7, 7]
    assert run("backward_fill") == [5, 5, 7, 7, 7, None]
    assert run("forward_fill", partition_by=["g"]) == [None, 5, None, 5, 7, 5]
    assert run("backward_fill", partition_by=["g"]) == [5, 5, 7, None, 7, None]


# --- duplicates -----------------------------------------------------------------------------------------------


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, 1), (3, "a", 1), (4, "a", 2)], "i int, k string, v int")
    ids = lambda keep: column(drop_duplicates(df, ["k", "v"], keep, ["i"]), "i")
    assert ids("first") == [1, 3, 4]
    assert ids("last") == [2, 3, 4]
    assert ids("none") == ids(False) == ids("False") == [3, 4]
    assert drop_duplicates(df, ["k", "v"], "none").columns == ["i", "k", "v"]
    assert column(drop_duplicates(df.select("k", "v").union(df.select("k", "v"))), "v") == [1, 1, 2]
    assert drop_duplicates(df.select("k", "v"), keep="none").count() == 2
    assert duplicate_count(df, ["k", "v"]).first() == (1, 4)
    for bad in ({"subset": ["k"]}, {"subset": ["z"]}, {"keep": "some"}):
        with pytest.raises(CleaningError):
            drop_duplicates(df, **bad)


def test_union(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert union_all(df, df.select("b", "a")).count() == 2
    with pytest.raises(CleaningError):
        union_all(df, df.drop("a"))


# --- statistics -----------------------------------------------------------------------------------------------


def test_statistics(spark):
    df = table(spark, [1.0, 2.0, 4.0, 10.0, None, NAN])
    got = measure(df, [Need("x", k) for k in (MEAN, STD, MEDIAN, QUARTILES, WHOLE)])
    assert got[Need("x", MEAN)] == 4.25 and got[Need("x", MEDIAN)] == 3.0
    assert got[Need("x", QUARTILES)] == (1.75, 5.5) and got[Need("x", WHOLE)] is True
    assert abs(got[Need("x", STD)] - 4.031128874149275) < 1e-12
    assert measure(df, [Need("x", QUARTILES)], exact=False)[Need("x", QUARTILES)] == (1.0, 4.0)
    assert mode(table(spark, [2, 1, 2, 1, 3], "int"), "x") == 1
    assert mode(table(spark, [None], "int"), "x") is None


def test_counts(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, None), (None, "a")], "x double, y string")
    assert {r[0]: r[1] for r in distinct_counts(df).collect()} == {"x": 1, "y": 1}
    assert {r[0]: r[1] for r in distinct_counts(df, approx=True).collect()}["y"] == 1
    assert null_counts(df).first().asDict() == {"x": 2, "y": 1, "total": 3}


# --- outliers -------------------------------------------------------------------------------------------------


def test_clip_outliers(spark):
    assert column(clip_outliers(table(spark, []), "x")) == []
    assert column(clip_outliers(table(spark, [5.0]), "x")) == [5.0]
    assert column(clip_outliers(table(spark, [5.0]), "x", "zscore")) == [5.0]
    assert column(clip_outliers(table(spark, [None, None]), "x")) == [None, None]
    df = table(spark, [None, 1.0, 2.0, 1000.0])
    assert column(clip_outliers(df, "x")) == [None, 1.0, 2.0, 1000.0]
    assert column(clip_outliers(df, "x", threshold=0)) == [None, 1.5, 2.0, 501.0]
    assert column(clip_outliers(df, "x", "drop", threshold=0)) == [2.0]
    assert column(clip_outliers(df, "x", bounds=(0, 10))) == [None, 1.0, 2.0, 10.0]
    texts = table(spark, ["1", "x", "2"], "string")
    assert column(clip_outliers(texts, "x", bounds=(0, 1))) == [None, 1.0, 1.0]
    assert column(clip_outliers(texts, "x", "drop", bounds=(0, 1))) == ["1"]
    assert clip_outliers(table(spark, [None]), "x", "drop").count() == 0
    for bad in ({"method": "magic"}, {"threshold": "much"}):
        with pytest.raises(CleaningError):
            clip_outliers(df, "x", **bad)


# --- formats --------------------------------------------------------------------------------------------------


def test_formats_refuse(spark):
    df = table(spark, ["a"], "string")
    for bad in (
        lambda: normalize_format(df, "x", "iban"), lambda: normalize_format(df, "x", "text_case", "snake"),
        lambda: standardize_text(df, "x", ["polish"]), lambda: standardize_text(df, "x", "strip"),
        lambda: apply_regex(df, "x", "(", ""), lambda: apply_regex(df, "y", "a", ""),
    ):
        with pytest.raises(CleaningError):
            bad()


def test_formats_of_typed_columns(spark):
    day = table(spark, [datetime.date(2020, 1, 2), None], "date")
    assert column(normalize_format(day, "x", "date", "%m/%d/%Y")) == [None, "01/02/2020"]
    assert column(normalize_format(table(spark, [1.5, None]), "x", "strip_currency")) == [None, 1.5]


@pytest.mark.parametrize("kind", ["phone", "email", "date", "strip_currency", "zip_code"])
def test_formats_are_stable(spark, kind):
    df = table(spark, ["+1 (123) 456-7890", " A@B.com", "Jan 5, 1990", "$1,200", "94105-1", "n/a", "", None], "string")
    once = normalize_format(df, "x", kind)
    assert column(normalize_format(once, "x", kind)) == column(once)


# --- references -----------------------------------------------------------------------------------------------


def test_null_keys_match_each_other(spark):
    left = table(spark, [1, None], "int", "k")
    right = spark.createDataFrame([(None, "n"), (1, "a"), (1, "b")], "k int, v string")
    merged = merge_tables(left, "r", "k", "k", "left", tables={"r": right})
    assert sorted(map(tuple, merged.collect()), key=repr) == [(1, "a"), (1, "b"), (None, "n")]
    plain = merge_tables(left, "r", "k", "k", "left", tables={"r": right}, match_nulls=False)
    assert sorted(map(tuple, plain.collect()), key=repr) == [(1, "a"), (1, "b"), (None, None)]


def test_merge_names(spark):
    left = spark.createDataFrame([(1, "x")], "id int, name string")
    right = spark.createDataFrame([(1, "y", 3)], "cid int, name string, v int")
    assert merge_tables(left, "r", "id", "cid", tables={"r": right}).columns == ["id", "name", "cid", "name_r", "v"]
    assert merge_tables(left, "r", "id", "cid", columns=["v", "no"], tables={"r": right}).columns == ["id", "name", "cid", "v"]
    clash = left.withColumn("name_r", F.lit(1))
    text = right.withColumn("cid", F.col("cid").cast("string"))
    for bad in (
        lambda: merge_tables(left, "q", "id", "cid", tables={"r": right}),
        lambda: merge_tables(left, "r", "id", "cid", "cross", tables={"r": right}),
        lambda: merge_tables(left, "r", "no", "cid", tables={"r": right}),
        lambda: merge_tables(clash, "r", "id", "cid", tables={"r": right}),
        lambda: merge_tables(left, "r", "id", "cid", tables={"r": text}),
    ):
        with pytest.raises(CleaningError):
            bad()


def test_foreign_keys(spark):
    child = table(spark, [1, 2, None, 1], "int", "k")
    tables = {"p": table(spark, [1, 1, None], "int", "id")}
    assert column(fix_referential_integrity(child, "k", "p", "id", tables=tables), "k") == [1, 1]
    flagged = fix_referential_integrity(child, "k", "p", "id", "flag", tables=tables)
    assert sorted(map(tuple, flagged.collect()), key=repr) == [(1, 1), (1, 1), (2, 0), (None, 0)]
    assert fix_referential_integrity(flagged, "k", "p", "id", "flag", tables=tables).columns == ["k", "k_valid"]
    assert column(fk_violations(child, "k", "p", "id", tables), "k") == [None, 2]
    with pytest.raises(CleaningError):
        fix_referential_integrity(child, "k", "p", "id", "mend", tables=tables)
