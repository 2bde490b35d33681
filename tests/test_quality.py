"""Profiles, issues, scores and the downstream model."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.errors import CleaningError
from burnish.operators.stats import QUARTILES, Need
from burnish.quality import profile, regression, scores
from burnish.quality.regression import downstream_r2, label_encode

PEOPLE = "id bigint, name string, age double, salary string"


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann Lee", 34.0, "$1,000.00"), (1, "Ann Lee", 34.0, "$1,000.00"), (2, "bob", None, None), (3, None, float("nan"), "5")]
    return spark.createDataFrame(rows, PEOPLE)


def test_profile(people):
    got = {r["column_name"]: r for r in profile.column_profile(people, ["id"]).collect()}
    assert got["age"]["null_count"] == 2 and got["age"]["null_pct"] == 50.0 and got["age"]["unique_count"] == 1
    assert got["age"]["detected_issues"] == ["missing_values (2 nulls, 50.0%)", "stored_as_float — should be int"]
    assert got["salary"]["detected_issues"] == ["missing_values (1 nulls, 25.0%)", "currency_string — should be numeric"]
    assert got["id"]["detected_issues"] == [] and got["id"]["dtype"] == "bigint" and got["id"]["sample_values"] == ["1", "1", "2", "3"]
    assert [got[c]["position"] for c in ("id", "name", "age", "salary")] == [0, 1, 2, 3]


def test_stats(people):
    got = profile.dataset_stats(people).first().asDict()
    assert got == {
        "total_rows": 4, "total_cols": 4, "missing_cells": 4, "missing_pct": 25.0, "duplicate_rows": 1, "dtype_issues": 2,
        "format_violations": 2,
    }


def test_issues(people):
    rows = {(r["issue_type"], r["column"]): r for r in profile.detect_issues(people).collect()}
    assert set(rows) == {
        ("missing_values", "name"), ("missing_values", "age"), ("missing_values", "salary"), ("duplicate_rows", None),
        ("wrong_dtype", "salary"),
    }
    assert rows["duplicate_rows", None]["description"] == "1 duplicate rows detected"
    assert rows["wrong_dtype", "salary"]["description"] == "'salary' contains 2 currency-formatted strings; expected numeric"
    assert rows["missing_values", "age"]["description"] == "2 missing values (50.0%)"
    assert {r["severity"] for r in rows.values()} == {"high", "medium"}
    top = profile.top_issues(profile.detect_issues(people), 2).collect()
    assert [(r["column"], r["affected_rows"]) for r in top] == [("age", 2), ("salary", 2)]


def test_severity_needs_more_than_a_tenth(spark):
    df = spark.range(10).select(F.when(F.col("id") > 0, 1).alias("x"))
    assert profile.detect_missing(df).first()["severity"] == "medium"


def test_whole_numbers_stored_as_float(spark):
    df = spark.createDataFrame([(1.0, 1.5, None), (2.0, 2.0, None)], "a double, b double, c double")
    assert [r["column"] for r in profile.detect_float_as_int(df).collect()] == ["a"]
    assert profile.detect_float_as_int(df, ["b"]).count() == 0


def test_formats_and_schema(spark):
    df = spark.createDataFrame([("Ann", "2020-01-05", "US"), ("bob", "05.01.2020", "us"), (None, None, None)], "n string, d string, c string")
    rules = {"n": "title_case", "d": "%Y-%m-%d", "c": r"^[A-Z]{2}$", "absent": "upper_case"}
    assert {r["column"]: r["affected_rows"] for r in profile.detect_format_violation(df, rules).collect()} == {"n": 1, "d": 1, "c": 1}
    found = profile.detect_schema_mismatch(df, {"n": {"dtype": "string"}, "d": {"dtype": "datetime"}, "z": {"dtype": "int"}})
    assert {r["column"]: r["description"] for r in found.collect()} == {
        "d": "type is string; expected datetime", "z": "column is absent; expected int",
    }
    assert profile.detect_format_violation(df, {}).count() == 0


def test_outliers_and_references(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(20)] + [(1e6, 9), (None, None)], "x double, k int")
    assert [(r["issue_type"], r["affected_rows"]) for r in profile.detect_outliers(df, ["x"]).collect()] == [("outlier", 1)]
    parents = {"p": spark.createDataFrame([(0,), (1,), (2,)], "id int")}
    assert profile.detect_fk(df, "k", "p", "id", parents).first()["affected_rows"] == 2


@pytest.mark.parametrize("schema", [PEOPLE, "price double, quantity bigint, customer_id int, product string"])
def test_empty_tables(spark, schema):
    df = spark.createDataFrame([], schema)
    assert profile.dataset_stats(df).first()["total_rows"] == 0
    assert profile.detect_issues(df).count() == 0
    assert profile.column_profile(df, [df.columns[0]]).count() == len(df.columns)
    assert scores.scorecard_customers(df).first()["completeness"] == 0
    assert scores.scorecard_contacts(df).first()["overall"] == 0
    parents = spark.createDataFrame([(1,)], "customer_id int")
    card = scores.scorecard_orders(df, parents, df).first()
    assert card["referential_integrity"] == 0 and card["deduplication"] == 0 and card["downstream_ml"] == 0
    assert card["outlier_removal"] == 0.5


def test_single_scores(people):
    one = lambda a: scores.score(people, "s", a).first()[0]
    assert one(scores.completeness(people, ["age", "salary", "none"])) == 0.625
    assert one(scores.completeness(people, ["none"])) == 0
    assert one(scores.currency_numeric(people, "salary")) == round((0.25 + 0.5) / 2, 4)
    assert one(scores.integer_type(people, "age")) == 0.75
    assert one(scores.title_case(people, "name")) == 0.6667
    assert one(scores.matches(people, "none", "a")) == 0
    assert scores.score_dedup(people).first()[0] == 0.75


def test_weights_add_up():
    for weights in (scores.CUSTOMER_WEIGHTS, scores.CONTACT_WEIGHTS, scores.ORDER_WEIGHTS):
        assert abs(sum(weights.values()) - 1) < 1e-12


def test_outlier_removal(spark):
    original = spark.createDataFrame([(float(i),) for i in range(100)] + [(1000.0,), (-900.0,)], "price double")
    fence = scores.outlier_reference(original)
    low, high = fence[Need("price", QUARTILES)]
    top = high + 1.5 * (high - low)
    share = lambda df: scores.score_outlier_removal(df, fence).first()[0]
    assert share(original) == 0.0
    assert share(original.where("price BETWEEN -50 AND 150")) == 1.0
    half = spark.createDataFrame([(0.0,), (top + (1000 - top) / 2,)], "price double")
    assert share(half) == 0.75
    assert share(half.where("false")) == 0.5
    assert scores.score_outlier_removal(original.withColumnRenamed("price", "p"), original).first()[0] == 0.5


def least_squares(rows):
    y = np.array([p * q for p, q, *_ in rows], dtype=float)
    x = np.column_stack([np.ones(len(y)), np.array([r for r in rows], dtype=float)])
    fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("segments", [True, False])
@pytest.mark.parametrize("short_list", [100, 1])
def test_fit_equals_least_squares(spark, monkeypatch, segments, short_list):
    monkeypatch.setattr(regression, "SHORT_LIST", short_list)
    rng = np.random.default_rng(1)
    products, names = ["b", "a", "c"], ["y", "x", None]
    rows = [
        (float(rng.uniform(1, 500)), int(rng.integers(1, 20)), products[rng.integers(3)], names[rng.integers(3)]) for _ in range(300)
    ]
    df = spark.createDataFrame(rows, "price double, quantity int, product string, segment string")
    codes = {"a": 0, "b": 1, "c": 2}, {None: 0, "x": 1, "y": 2}
    want = least_squares([(p, q, codes[0][a], codes[1][s]) if segments else (p, q, codes[0][a]) for p, q, a, s in rows])
    assert abs(downstream_r2(df if segments else df.drop("segment")) - want) < 1e-9


def test_fit_that_cannot_be(spark):
    few = spark.createDataFrame([(1.0, 2)] * 9, "price double, quantity int")
    assert downstream_r2(few) == 0 and downstream_r2(few.drop("price")) == 0
    assert downstream_r2(few.union(few)) == 1
    encoded = label_encode(few, "product", "code")
    assert {r["code"] for r in encoded.collect()} == {0}


def test_generic_card(spark):
    df = spark.createDataFrame([("a",), ("B",), (None,)], "x string")
    card = scores.scorecard_generic(df, {"lower": (0.5, scores.matches(df, "x", "^[a-z]$")), "all": (0.5, F.lit(1.0))})
    assert [tuple(r) for r in card.collect()] == [("lower", 0.5, 0.5, 0.25), ("all", 0.5, 1.0, 0.5)]
    with pytest.raises(CleaningError):
        scores.scorecard_generic(df, {})
