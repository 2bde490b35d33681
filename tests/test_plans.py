"""Running plans: failures, records, the loss guard, shared statistics, recommendations, steps in text."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from burnish.operators import stats as statistics
from burnish.operators.inject import gen_contacts, gen_customers, gen_orders, gen_people
from burnish.operators.stats import MEDIAN, WHOLE, Need
from burnish.plans import runner
from burnish.plans.actions import ACTIONS
from burnish.plans.recipes import CUSTOMERS, plan_contacts, plan_customers, plan_orders, step
from burnish.plans.recommend import recommend_actions, steps_of
from burnish.plans.responses import parse_actions
from burnish.plans.runner import run_plan
from burnish.quality.profile import detect_fk, detect_format_violation, detect_issues, detect_outliers
from burnish.quality.scores import outlier_reference, scorecard_contacts, scorecard_customers, scorecard_orders


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, 10.0, " a "), (2, None, "b"), (3, 30.0, None), (3, 30.0, None)], "k int, x double, s string")


@pytest.mark.parametrize(
    "bad",
    [
        {"action_type": "polish"},
        {},
        step("drop_column"),
        step("drop_column", column="z"),
        step("drop_column", column="x", force=True),
        step("drop_column", column="x", df=None),
        step("fill_missing", column="x", strategy="magic"),
        step("fill_missing", column="z", strategy="median"),
        step("drop_duplicates", subset=["k"]),
        step("merge_tables", right_table="r", left_on="k", right_on="k"),
        step("fix_referential_integrity", child_column="k", parent_table="r", parent_column="k"),
        step("cast_column", column="s", dtype="int", on_fraction="maybe"),
        step("clip_outliers", column="x", method="magic"),
        step("apply_regex", column="s", pattern="(", replacement=""),
    ],
)
def test_failures_leave_no_trace(small, bad):
    result = run_plan(small, [bad, step("drop_column", column="s")])
    assert [r.success for r in result.records] == [False, True] and result.records[0].message
    assert result.df.columns == ["k", "x"] and result.df.count() == 4


def test_every_action_runs(spark, small):
    tables = {"r": spark.createDataFrame([(1, "one"), (3, "three")], "k int, v string")}
    steps = [
        step("fill_missing", column="x", strategy="median"),
        step("drop_duplicates"),
        step("cast_column", column="x", dtype="int"),
        step("rename_column", old_name="s", new_name="t"),
        step("normalize_format", column="t", format_type="text_case", output_format="upper"),
        step("apply_regex", column="t", pattern="B", replacement="C"),
        step("standardize_text", column="t", operations=["strip"]),
        step("clip_outliers", column="x", method="zscore", threshold=1),
        step("drop_rows_by_condition", column="t", operator="isnull", value=None),
        step("fix_referential_integrity", child_column="k", parent_table="r", parent_column="k", action="flag"),
        step("merge_tables", right_table="r", left_on="k", right_on="k"),
        step("drop_column", column="x"),
    ]
    assert {s["action_type"] for s in steps} == set(ACTIONS)
    result = run_plan(small, steps, tables, order_by=["k"])
    assert all(r.success for r in result.records), result.records
    assert sorted(map(tuple, result.df.collect())) == [(1, "A", 1, "one"), (2, "C", 0, None)]


def test_record_and_guard(small):
    steps = [
        step("drop_duplicates"),
        step("drop_rows_by_condition", column="k", operator=">", value=1),
        step("fill_missing", column="x", strategy="constant", fill_value=0),
    ]
    rows = run_plan(small, steps, audit=True).audit().orderBy("step").collect()
    assert [(r["rows_before"], r["rows_after"], r["row_loss"]) for r in rows] == [(4, 3, False), (3, 1, True), (1, 1, False)]
    assert json.loads(rows[1]["parameters"]) == {"column": "k", "operator": ">", "value": 1}
    stopped = run_plan(small, steps, on_loss="abort")
    assert stopped.aborted and stopped.df.count() == 3 and [r.success for r in stopped.records] == [True, False]
    exact = run_plan(small.limit(10), [step("drop_rows_by_condition", column="k", operator="==", value=1)], audit=True)
    assert exact.records[0].row_loss is False


def test_scores_before_and_after(small):
    share = lambda df: df.agg(F.count("x") / F.count("*")).first()[0]
    steps = [step("drop_duplicates"), step("fill_missing", column="x", strategy="mean"), step("drop_column", column="no")]
    records = run_plan(small, steps, score=share).records
    assert [(r.score_before, r.score_after, r.score_delta) for r in records] == [
        (0.75, 0.6667, -0.0833), (0.6667, 1.0, 0.3333), (1.0, 1.0, 0.0),
    ]


def test_statistics_are_shared(spark, small, monkeypatch):
    calls = []
    monkeypatch.setattr(runner, "measure", lambda df, needs, exact: calls.append(list(needs)) or statistics.measure(df, needs, exact))
    df = small.withColumn("y", F.col("x"))
    steps = [
        step("fill_missing", column="x", strategy="median"),
        step("standardize_text", column="s", operations=["strip"]),
        step("fill_missing", column="y", strategy="median"),
        step("cast_column", column="x", dtype="int"),
    ]
    result = run_plan(df, steps)
    assert calls == [[Need("x", MEDIAN), Need("y", MEDIAN)], [Need("x", WHOLE)]]
    assert result.df.where("x IS NULL OR y IS NULL").count() == 0


def test_known_statistics_need_no_job(small):
    steps = [step("fill_missing", column="x", strategy="median")]
    result = run_plan(small, steps, stats={Need("x", MEDIAN): 7.0})
    assert result.stats == {} and result.df.where("x = 7").count() == 1


def test_fractional_median_keeps_age_a_double(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "d", "$1", "e"), (2, "b", 2.0, "d", "$2", "e"), (3, "c", None, "d", "$2", "e")],
                               "id int, name string, age double, department string, salary string, email string")
    result = run_plan(df, CUSTOMERS)
    assert [r.success for r in result.records] == [True, True, True, False, True, True, True, True]
    assert result.df.schema["age"].dataType.simpleString() == "double"


def test_plans_raise_the_scores(spark):
    keys = spark.range(1, 401)
    people = gen_people(keys, "id")
    assert scorecard_customers(plan_customers(people).df).first()["overall"] > scorecard_customers(people).first()["overall"]
    contacts = gen_contacts(keys, "id")
    before, after = scorecard_contacts(contacts).first()["overall"], scorecard_contacts(plan_contacts(contacts).df).first()["overall"]
    assert after > 0.99 > before
    customers, orders = gen_customers(spark.range(1, 101), "id"), gen_orders(keys, "id", 100)
    reference = outlier_reference(orders)
    rate = lambda df: scorecard_orders(df, customers, reference).first()["overall"]
    assert rate(plan_orders(orders, customers).df) > 0.9 > rate(orders)


def test_recommended_steps_mend_the_table(spark):
    customers, orders = gen_customers(spark.range(1, 51), "id"), gen_orders(spark.range(1, 301), "id", 50)
    issues = (
        detect_issues(orders)
        .union(detect_fk(orders, "customer_id", "customers", "customer_id", {"customers": customers}))
        .union(detect_outliers(orders, ["price", "quantity"]))
    )
    steps = steps_of(recommend_actions(issues, orders, parents={"customer_id": ("customers", "customer_id")}))
    assert [s["action_type"] for s in steps] == ["fix_referential_integrity", "clip_outliers", "clip_outliers"]
    result = run_plan(orders, steps, {"customers": customers}, order_by=["order_id"])
    assert all(r.success for r in result.records)
    assert detect_fk(result.df, "customer_id", "customers", "customer_id", {"customers": customers}).count() == 0

    people = gen_people(spark.range(1, 301), "id")
    rules = {"name": "title_case"}
    found = detect_issues(people).union(detect_format_violation(people, rules))
    mended = run_plan(people, steps_of(recommend_actions(found, people, formats=rules)))
    assert all(r.success for r in mended.records)
    left = detect_issues(mended.df)
    assert left.where("issue_type <> 'wrong_dtype'").count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"action_type": "a", "parameters": {"k": 1, "l": [1, 2], "s": "x"}}', ("a", {"k": "1", "l": "[1,2]", "s": "x"})),
        ('Sure!\n```json\n{"action_type": "a"}\n```\nDone', ("a", {})),
        ('```{"parameters": {}}```', ("", {})),
        ("  {}  ", ("", {})),
        ('``` {"action_type": "a"}', None),
        ('{"action_type": "a"', None),
        ('{"action_type": "a"} and more', None),
        ('{"action_type": "a"}, {"action_type": "b"}', None),
        ("{'action_type': 'a'}", None),
        ('["action_type"]', None),
        ('"text"', None),
        ("", None),
        (None, None),
    ],
)
def test_steps_in_text(spark, text, want):
    row = parse_actions(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row["action_type"], row["parameters"]) == (want or (None, None))


def test_audit_of_what_each_step_did(spark, monkeypatch):
    """One counting job, nothing written, and the effect of every kind of step."""
    monkeypatch.setattr(runner, "settle", lambda df: pytest.fail("a plan that only counts writes nothing"))
    rows = [(1, 10.0, " a ", "5"), (2, None, "b", "x"), (3, 30.0, None, "7"), (3, 30.0, None, "7"), (4, float("nan"), "d", None), (5, 9000.0, "e", "1")]
    df = spark.createDataFrame(rows, "k int, x double, s string, n string")
    tables = {"r": spark.createDataFrame([(1, "one"), (3, "three"), (3, "drei"), (5, "five")], "k int, v string")}
    steps = [
        step("drop_duplicates"),
        step("fill_missing", column="x", strategy="constant", fill_value=20.0),
        step("standardize_text", column="s", operations=["strip"]),
        step("fill_missing", column="s", strategy="constant", fill_value=3),
        step("normalize_format", column="n", format_type="strip_currency"),
        step("clip_outliers", column="x", bounds=[15, 40]),
        step("fix_referential_integrity", child_column="k", parent_table="r", parent_column="k", action="flag"),
        step("merge_tables", right_table="r", left_on="k", right_on="k"),
        step("drop_rows_by_condition", column="k", operator=">", value=2),
        step("rename_column", old_name="v", new_name="w"),
    ]
    result = run_plan(df, steps, tables, order_by=["k"], audit=True)
    r = result.records
    assert [(x.rows_before, x.rows_after) for x in r] == [(6, 5), (5, 5), (5, 5), (5, 5), (5, 5), (5, 5), (5, 5), (5, 6), (6, 2), (2, 2)]
    assert [x.success for x in r] == [True] * 3 + [False] + [True] * 6
    assert (r[0].rows_removed, r[7].rows_added, r[8].rows_removed, r[8].row_loss) == (1, 1, 4, True)
    assert (r[1].cells_changed, r[1].cells_filled, r[1].cells_emptied, r[1].fill_value) == (2, 2, 0, "20.0")
    assert (r[2].cells_changed, r[2].cells_filled) == (1, 0)
    assert (r[4].cells_changed, r[4].cells_emptied) == (4, 1)
    assert (r[5].cells_changed, r[5].lower_bound, r[5].upper_bound) == (2, 15.0, 40.0)
    assert (r[6].rows_flagged, r[6].columns_added) == (2, ["k_valid"])
    assert r[7].columns_added == ["v"] and (r[9].columns_added, r[9].columns_removed) == (["w"], ["v"])
    assert "2 cells filled; fill value 20.0" in r[1].message and r[9].message.endswith("columns added w; columns removed v")
    assert result.df.columns == ["k", "x", "s", "n", "k_valid", "w"] and result.audit().count() == 10


def test_writing_the_result_fills_the_record(spark, small, monkeypatch, tmp_path):
    result = run_plan(small, [step("drop_duplicates"), step("drop_rows_by_condition", column="k", operator="==", value=1)], audit=True)
    result.df.write.parquet(str(tmp_path / "out"))
    monkeypatch.setattr(type(result.df), "agg", lambda *a: pytest.fail("counted again"))
    assert [(x.rows_before, x.rows_after) for x in result.records] == [(4, 3), (3, 2)]


def test_counts_survive_steps_that_run_jobs_of_their_own(spark):
    """Windows, fills cut into ranges, and statistics taken between the steps."""
    df = spark.range(2000).selectExpr("id AS k", "CASE WHEN id % 3 > 0 THEN id END AS x", "CAST(id % 7 AS STRING) AS s").repartition(5)
    steps = [
        step("drop_duplicates", subset=["k"]),
        step("drop_rows_by_condition", column="s", operator="==", value="0"),
        step("fill_missing", column="x", strategy="forward_fill"),
        step("fill_missing", column="x", strategy="median"),
        step("clip_outliers", column="x", method="zscore", threshold=1.0),
    ]
    r = run_plan(df, steps, order_by=["k"], audit=True).records
    assert all(x.success for x in r), r
    kept = sum(1 for i in range(2000) if i % 7)
    assert [x.rows_after for x in r] == [2000, kept, kept, kept, kept]
    assert r[2].cells_filled + r[3].cells_filled == sum(1 for i in range(2000) if i % 7 and i % 3 == 0)
