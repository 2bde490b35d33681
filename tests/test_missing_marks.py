"""NaN counts as null in every operator, plans survive bad steps, and patterns mean what they mean in Python."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from burnish.errors import CleaningError
from burnish.functions.formats import parse_date
from burnish.functions.patterns import pattern
from burnish.operators.formats import apply_regex, normalize_format
from burnish.operators.missing import fill_missing
from burnish.operators.ordered import ranked_values, sample_values
from burnish.operators.rows import drop_duplicates, drop_rows_by_condition
from burnish.operators.stats import duplicate_count, mode, null_counts
from burnish.plans.responses import parse_actions, steps_from
from burnish.plans.runner import run_plan
from burnish.quality.profile import dataset_stats
from burnish.quality.scores import score_dedup

NAN = math.nan


@pytest.fixture()
def gaps(spark):
    rows = [(1, 2.0, "a"), (2, NAN, "a"), (3, None, "b"), (4, NAN, "b"), (5, 5.0, "a"), (6, NAN, None), (7, NAN, "c"), (8, None, "c")]
    return spark.createDataFrame(rows, "t int, x double, y string")


def values(df):
    return [r.x for r in df.orderBy("t").collect()]


def test_neighbours_fill_nan(gaps):
    assert values(fill_missing(gaps, "x", "forward_fill", order_by=["t"])) == [2.0, 2.0, 2.0, 2.0, 5.0, 5.0, 5.0, 5.0]
    assert values(fill_missing(gaps, "x", "backward_fill", order_by=["t"]))[:5] == [2.0, 5.0, 5.0, 5.0, 5.0]


def test_conditions_and_counts_see_nan_as_null(gaps):
    assert values(drop_rows_by_condition(gaps, "x", "isnull")) == [2.0, 5.0]
    assert drop_rows_by_condition(gaps, "x", "notnull").count() == 6
    assert null_counts(gaps).first()["x"] == 6
    assert mode(gaps, "x") == 2.0
    assert {r["column_name"]: r["sample_values"] for r in sample_values(gaps, ["t"]).collect()}["x"] == ["2.0", "5.0"]
    assert ranked_values(gaps, "x", "c").count() == 2


def test_nan_and_null_are_the_same_in_duplicates(gaps):
    pairs = gaps.select("x", "y")
    assert duplicate_count(pairs).first()["duplicate_rows"] == 2
    assert dataset_stats(pairs).first()["duplicate_rows"] == 2
    assert score_dedup(pairs).first()[0] == 0.75
    assert drop_duplicates(pairs, keep="first").count() == 6
    assert sorted(r.t for r in drop_duplicates(gaps, ["x", "y"], "first", ["t"]).collect()) == [1, 2, 3, 5, 6, 7]
    assert sorted(r.t for r in drop_duplicates(gaps, ["x", "y"], "last", ["t"]).collect()) == [1, 2, 4, 5, 6, 8]
    assert sorted(r.t for r in drop_duplicates(gaps, ["x", "y"], "none").collect()) == [1, 2, 5, 6]


BAD_STEPS = [
    5, None, {"action_type": 3}, {"action_type": "drop_column", "parameters": [1]}, {"action_type": "drop_column", "parameters": "y"},
    {"action_type": "normalize_format", "parameters": {"column": "y", "format_type": "date", "output_format": 5}},
    {"action_type": "clip_outliers", "parameters": {"column": "x", "bounds": [1]}},
    {"action_type": "apply_regex", "parameters": {"column": "y", "pattern": "(?(1)a|b)", "replacement": ""}},
    {"action_type": "apply_regex", "parameters": {"column": "y", "pattern": "(a)", "replacement": r"\2"}},
    {"action_type": "apply_regex", "parameters": {"column": "y", "pattern": "(", "replacement": ""}},
    {"action_type": "drop_rows_by_condition", "parameters": {"column": "d", "operator": "==", "value": "soon"}},
    {"action_type": "normalize_format", "parameters": {"column": "y", "format_type": "date", "layouts": ["bbbb"]}},
    {"action_type": "normalize_format", "parameters": {"column": "y", "format_type": "date", "layouts": "yyyy"}},
    {"action_type": "merge_tables", "parameters": {"column": "x"}},
]


def test_bad_steps_fail_without_harm(gaps):
    df = gaps.withColumn("d", F.lit("2024-01-01").cast("date"))
    good = {"action_type": "rename_column", "parameters": {"old_name": "y", "new_name": "z"}}
    result = run_plan(df, [*BAD_STEPS, good], audit=True)
    assert [r.success for r in result.records] == [False] * len(BAD_STEPS) + [True]
    assert all(r.message for r in result.records)
    assert result.df.columns == ["t", "x", "z", "d"] and len(result.df.collect()) == 8
    assert result.audit().count() == len(BAD_STEPS) + 1


def test_dates_may_be_written_out(gaps):
    df = gaps.withColumn("d", F.when(F.col("t") > 4, F.lit("2024-01-01").cast("date")))
    filled = run_plan(df, [{"action_type": "fill_missing", "parameters": {"column": "d", "strategy": "constant", "fill_value": "2024-02-03"}}])
    assert filled.records[0].success and filled.df.where("d = DATE '2024-02-03'").count() == 4


TEXTS = ["94105", "94105\r", "94105\u2028", "94105\n", "94105\n\n", "a\rb", "a\nb", "axb", "&", "a", "[", "]", "^", "aab", "b", "aaaab", "x]", "a&&b", "é", "\u0085"]
PATTERNS = [r"^\d{5}$", r"^a.b$", "[a&&b]", "a{,2}b", "[[]", "[]x]", "[^]a]", r"[\[a]", "a{,3}b$", r"^a{,}b", r"\d+\Z", "(?P<q>a)(?P=q)", r"[&&]", "x]", r"^\w$"]


@pytest.mark.parametrize("source", PATTERNS)
def test_patterns_mean_what_python_means(spark, source):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i for r in df.where(F.col("t").rlike(pattern(source))).collect()}
    assert got == {i for i, t in enumerate(TEXTS) if re.search(source, t)}
    sub = {r.i: r.t for r in apply_regex(df, "t", source, "_").collect()}
    assert sub == {i: re.sub(source, "_", t) for i, t in enumerate(TEXTS)}


def test_patterns_without_equivalent_are_refused(spark):
    for source in ("(?(1)a|b)", "(?P<a>x)(?(a)y)"):
        with pytest.raises(CleaningError):
            pattern(source)


def test_dates_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00",), ("3/9/2024",), ("Jan 5, 1890",), ("no",), (None,)], "d string")
    before = spark.conf.get("spark.sql.session.timeZone")
    seen = []
    try:
        for zone in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            read = df.select(parse_date(F.col("d")).cast("string")).collect()
            seen.append([r[0] for r in read])
            shown = normalize_format(df, "d", "date").collect()
            seen.append([r[0] for r in shown])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert seen[0] == ["2024-03-10 02:30:00", "2024-03-09 00:00:00", "1890-01-05 00:00:00", None, None]
    assert seen[0::2] == [seen[0]] * 3 and seen[1::2] == [seen[1]] * 3


def test_replies_become_a_plan_that_runs(spark, gaps):
    replies = [
        (1, '{"action_type": "standardize_text", "parameters": {"column": "y", "operations": ["strip", "upper"]}}'),
        (2, "```json\n{\"action_type\": \"clip_outliers\", \"parameters\": {\"column\": \"x\", \"bounds\": [3, 4.5]}}\n```"),
        (3, "no step here"),
        (4, '{"action_type": "drop_duplicates", "parameters": {"subset": ["y"], "keep": "first", "order_by": ["t"]}}'),
        (5, '{"action_type": "dance", "parameters": {}}'),
    ]
    parsed = parse_actions(spark.createDataFrame(replies, "n int, reply string"), "reply")
    result = run_plan(gaps, steps_from(parsed, ["n"]))
    assert [r.success for r in result.records] == [True, True, True, False]
    assert [(r.t, r.x, r.y) for r in result.df.orderBy("t").collect()][:2] == [(1, 3.0, "A"), (3, None, "B")]
