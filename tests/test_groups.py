"""Statistics per group against brute force, with a hot group, null keys and forced large paths; reports and replies."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from burnish.errors import CleaningError
from burnish.operators.grouped import grouped_stats
from burnish.operators.joining import JoinLimits
from burnish.operators.missing import fill_missing
from burnish.operators.outliers import clip_outliers
from burnish.operators.references import merge_report, merge_tables
from burnish.operators.stats import MEAN, MEDIAN, MODE, QUARTILES, STD
from burnish.plans.recipes import step
from burnish.plans.recommend import recommend_actions, steps_of
from burnish.plans.responses import best_plan, parse_actions, reply_plans, steps_from
from burnish.plans.runner import run_plan
from burnish.quality.profile import detect_padding
from burnish.quality.scores import completeness, score_dedup, scorecard_generic

LIMITS = [JoinLimits(), JoinLimits(broadcast_bytes=-1, hot_rows=20)]


@pytest.fixture(scope="module")
def table(spark):
    """A third of the rows is one group; one group has a single value, one has none; NaN is a missing value and key."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{i % 11}", rng.choice([None, float("nan"), float(rng.randrange(40)), rng.gauss(0, 9)])) for i in range(900)]
    rows += [(1000, "one", 5.0), (1001, "one", None), (1002, "none", None), (1003, "none", None)]
    return rows, spark.createDataFrame(rows, "id int, g string, x double").repartition(5)


def values(rows):
    out = defaultdict(list)
    for _, g, x in rows:
        if x is not None and x == x:
            out[g].append(x)
    return out


def test_statistics_of_groups(table):
    rows, df = table
    want = values(rows)
    got = {r["__group"]["g0"]: r for r in grouped_stats(df, "x", [MEAN, STD, MEDIAN, QUARTILES, MODE], ["g"]).collect()}
    assert set(got) == set(want)
    for g, xs in want.items():
        counts = Counter(xs)
        found = [got[g][n] for n in (MEAN, "low", MEDIAN, "high", MODE)]
        assert np.allclose(found, [np.mean(xs), *np.quantile(xs, [0.25, 0.5, 0.75]), min(counts, key=lambda v: (-counts[v], v))])
        assert (got[g][STD] is None) if len(xs) == 1 else np.isclose(got[g][STD], np.std(xs, ddof=1))


@pytest.mark.parametrize("limits", LIMITS, ids=["small", "forced"])
@pytest.mark.parametrize("strategy", ["mean", "median", "mode"])
def test_fills_by_group(table, limits, strategy):
    rows, df = table
    middle = {"mean": np.mean, "median": np.median, "mode": lambda xs: min(Counter(xs), key=lambda v: (-Counter(xs)[v], v))}[strategy]
    fills = {g: float(middle(xs)) for g, xs in values(rows).items()}
    out = fill_missing(df, "x", strategy, partition_by=["g"], limits=limits)
    assert out.columns == df.columns
    got = {r.id: r.x for r in out.collect()}
    assert len(got) == len(rows)
    for i, g, x in rows:
        expected = fills.get(g) if x is None or x != x else x
        assert got[i] is None if expected is None else np.isclose(got[i], expected)


@pytest.mark.parametrize("limits", LIMITS, ids=["small", "forced"])
@pytest.mark.parametrize("method", ["iqr", "zscore", "drop"])
def test_outliers_by_group(table, limits, method):
    rows, df = table
    bounds = {}
    for g, xs in values(rows).items():
        low, high = np.quantile(xs, [0.25, 0.75])
        if method == "zscore":
            m, s = np.mean(xs), np.std(xs, ddof=1) if len(xs) > 1 else np.nan
            bounds[g] = (m - s, m + s) if len(xs) > 1 else (-np.inf, np.inf)
        else:
            bounds[g] = (low - (high - low), high + (high - low))
    got = {r.id: r.x for r in clip_outliers(df, "x", method, 1, partition_by=["g"], limits=limits).collect()}
    for i, g, x in rows:
        known = x is not None and x == x
        if method == "drop":
            assert (i in got) == (known and bounds[g][0] <= x <= bounds[g][1])
        else:
            assert np.isclose(got[i], np.clip(x, *bounds[g])) if known else got[i] is None


def test_types_of_fills_by_group(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "x"), ("a", None, None), ("b", None, None), ("b", 4, "y")], "g string, n int, s string")
    whole = fill_missing(df, "n", "median", partition_by=["g"])
    assert dict(whole.dtypes)["n"] == "int" and sorted(r.n for r in whole.collect()) == [1, 2, 3, 4, 4]
    broken = fill_missing(df.where("n IS NULL OR n <> 1").union(df.limit(1).selectExpr("g", "2 AS n", "s")), "n", "median", partition_by=["g"])
    assert dict(broken.dtypes)["n"] == "double" and 2.5 in {r.n for r in broken.collect()}
    assert sorted(r.s for r in fill_missing(df, "s", "mode", partition_by=["g"]).collect()) == ["x", "x", "x", "y", "y"]
    empty = fill_missing(df.where("false"), "n", "mean", partition_by=["g"])
    assert empty.count() == 0 and empty.columns == df.columns
    with pytest.raises(CleaningError):
        clip_outliers(df, "n", bounds=(0, 1), partition_by=["g"])
    result = run_plan(df, [step("fill_missing", column="n", strategy="median", partition_by=["g"]), step("clip_outliers", column="n", partition_by=["g"])], audit=True)
    assert [(r.success, r.cells_filled) for r in result.records] == [(True, 2), (True, 0)]


@pytest.mark.parametrize("nulls", [True, False])
def test_merge_report_tells_what_the_merge_does(spark, nulls):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,), (4,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (None, "e"), (None, "f"), (9, "g")], "k int, v string")
    tables = {"r": right}
    report = merge_report(left, "r", "k", "k", tables, nulls).first().asDict()
    merged = merge_tables(left, "r", "k", "k", "inner", tables=tables, match_nulls=nulls).count()
    assert merged == report["matched_left"] + report["multiplied_rows"] == (9 if nulls else 7)
    assert (report["left_rows"], report["right_rows"], report["unmatched_left"]) == (5, 7, 1 if nulls else 2)
    assert (report["unmatched_right"], report["repeated_keys"]) == ((1, 2) if nulls else (3, 1))
    assert set(merge_report(left.where("false"), "r", "k", "k", {"r": right.where("false")}).first()) == {0}


def test_padding_is_found_and_mended(spark):
    df = spark.createDataFrame([(1, " a", "x"), (2, "b\t", None), (3, "c", "y")], "k int, s string, t string")
    issues = detect_padding(df)
    assert [(r.issue_type, r.column, r.affected_rows) for r in issues.collect()] == [("format_violation", "s", 2)]
    steps = steps_of(recommend_actions(issues, df, {"s": "stripped", "t": "stripped"}))
    assert steps == [{"action_type": "standardize_text", "parameters": {"column": "s", "operations": ["strip"]}}]
    assert detect_padding(run_plan(df, steps).df).isEmpty() and detect_padding(df, ["t"]).isEmpty()


def test_tables_as_components(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3)], "a int, b int")
    rows = scorecard_generic(df, {"copies": (0.5, score_dedup(df)), "full": (0.5, completeness(df, ["a", "b"]))}).collect()
    assert [(r.component, r.score) for r in rows] == [("copies", 0.6667), ("full", 0.6667)]
    with pytest.raises(CleaningError):
        scorecard_generic(df, {"both": (1.0, df)})


def test_one_plan_is_chosen_before_it_is_collected(spark):
    good = '{"action_type": "drop_column", "parameters": {"column": "s"}}'
    texts = [(1, i, "nothing") for i in range(50)] + [(2, 2, good), (2, 1, good.replace('"s"', '"t"')), (None, 1, good), (3, 1, good.replace("drop_column", "polish"))]
    parsed = parse_actions(spark.createDataFrame(texts, "conv int, turn int, reply string"), "reply")
    plans = {r.conv: (r.replies, r.steps, r.known_steps) for r in reply_plans(parsed, ["conv"]).collect()}
    assert plans == {1: (50, 0, 0), 2: (2, 2, 2), None: (1, 1, 1), 3: (1, 1, 0)}
    assert [s["parameters"]["column"] for s in best_plan(parsed, ["conv"], ["turn"])] == ["t", "s"]
    assert best_plan(parsed.where("conv = 1"), ["conv"], ["turn"]) == []
    with pytest.raises(CleaningError):
        steps_from(parsed, ["turn"], most=2)
