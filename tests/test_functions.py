"""Column expressions on literal edge cases."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from burnish.errors import CleaningError
from burnish.functions import formats, patterns
from burnish.functions.numbers import clip, strip_currency, to_number
from burnish.functions.text import squeeze, standardize, strip, title


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r["r"] for r in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_numbers_in_text(spark):
    values = ["1d", " 12 ", "1e3", "", None, "nan", "-3.5", ".5", "inf", "1_0", "$1,200.50", "5.", "+7", " 8 ", "1 2"]
    want = [None, 12.0, 1000.0, None, None, None, -3.5, 0.5, None, None, None, 5.0, 7.0, 8.0, None]
    assert apply(spark, values, to_number) == want


def test_currency(spark):
    values = ["$45,200.00", "€ 1,000", "£3", "12.5", "free", None, ""]
    assert apply(spark, values, strip_currency) == [45200.0, 1000.0, 3.0, 12.5, None, None, None]


def test_clip(spark):
    assert apply(spark, [None, -5.0, 5.0, 50.0], lambda c: clip(c, 0, 10), "double") == [None, 0.0, 5.0, 10.0]
    assert apply(spark, [None, -5.0, 50.0], lambda c: clip(c, None, None), "double") == [None, -5.0, 50.0]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abzABZéÉößçñ0123 '-_.,\tà中ʰ", max_size=12), min_size=20, max_size=60))
def test_title_equals_python(spark, values):
    values = [v for v in values if "ß" not in v] + ["o'brien mary-jane 3rd", "mcDONALD o'neil x2y", "ÉCOLE été", "", "中a"]
    assert apply(spark, values, title) == [v.title() for v in values]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \t\n\x1c\x85\xa0\u2003\u3000", max_size=10), min_size=20, max_size=60))
def test_strip_and_squeeze_equal_python(spark, values):
    assert apply(spark, values, strip) == [v.strip() for v in values]
    assert apply(spark, values, squeeze) == [re.sub(r"\s+", " ", v).strip() for v in values]


def test_null_text_stays_null(spark):
    for name in ("strip", "lower", "upper", "title", "remove_extra_spaces"):
        assert apply(spark, [None], lambda c, n=name: standardize(c, [n])) == [None]
    with pytest.raises(CleaningError):
        standardize(F.col("v"), ["strip", "polish"])


def test_phone(spark):
    values = ["(123) 456-7890", "123-456-7890", "123.456.7890", "1234567890", "+1 (123) 456-7890", "456-7890", None, "2" * 11]
    want = ["(123) 456-7890"] * 5 + ["456-7890", None, "2" * 11]
    assert apply(spark, values, formats.phone) == want


def test_zip_and_email(spark):
    assert apply(spark, ["94105", "94105-1234", "none", None], formats.zip_code) == ["94105", "94105", None, None]
    assert apply(spark, ["  A@B.C \t", None], formats.email) == ["a@b.c", None]


def test_dates_in_many_layouts(spark):
    values = ["1990-01-05", "01/02/1990", "05-01-1990", "Jan 05, 1990", "Jan 5, 1990", "13/45/1990", "n/a", None, " 1990-01-05 "]
    got = apply(spark, values, lambda c: F.date_format(formats.parse_date(c), "yyyy-MM-dd"))
    assert got == ["1990-01-05", "1990-01-02", *["1990-01-05"] * 3, None, None, None, "1990-01-05"]


@pytest.mark.parametrize("shape", ["%Y-%m-%d", "%d.%m.%y", "%b %d, %Y", "%A %B %j", "%Y at %H:%M:%S", "100%% %Y", "it's %Y"])
def test_strftime_patterns(spark, shape):
    import datetime

    moment = datetime.datetime(2021, 3, 9, 14, 5, 6)
    df = spark.sql("SELECT TIMESTAMP_NTZ '2021-03-09 14:05:06' AS t")
    assert df.select(F.date_format("t", formats.date_pattern(shape))).first()[0] == moment.strftime(shape)


def test_unknown_directive():
    with pytest.raises(CleaningError):
        formats.date_pattern("%Q")


@pytest.mark.parametrize(
    ("pattern", "replacement"),
    [
        (r"(\d+)-(\d+)", r"\2-\1"),
        (r"(?P<a_b>\d+)", r"<\g<a_b>>"),
        (r"(\d)", r"\g<1>0"),
        (r"[\$,]", ""),
        (r"a", r"$1"),
        (r"(?P<x>a)(?P=x)", "b"),
        (r"x\Z", "end"),
        (r"\.", r"\\"),
        (r"-", r"\n"),
        (r"(\w+)@", r"\1 at "),
    ],
)
def test_regex_replacement_equals_python(spark, pattern, replacement):
    values = ["12-34", "$1,200", "aa b a", "x", "a.b", "mail@x", "été@x", ""]
    got = apply(
        spark, values,
        lambda c: F.regexp_replace(c, F.lit(patterns.pattern(pattern)), F.lit(patterns.replacement(replacement))),
    )
    assert got == [re.sub(pattern, replacement, v) for v in values]


def test_invalid_pattern():
    with pytest.raises(CleaningError):
        patterns.pattern("(")
