"""Statistics per group, reports of merges, padding, rows of a scorecard, and plans chosen among many replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.operators.missing import fill_missing
from burnish.operators.outliers import clip_outliers
from burnish.operators.references import merge_report
from burnish.plans.recipes import step
from burnish.plans.recommend import recommend_actions, steps_of
from burnish.plans.responses import best_plan, parse_actions, reply_plans
from burnish.plans.runner import run_plan
from burnish.quality.profile import detect_padding
from burnish.quality.scores import (
    CONTACT_WEIGHTS,
    breakdown,
    score_dedup,
    score_fk,
    scorecard_contacts,
    scorecard_generic,
    stripped,
)
from burnish.queries.dirty import contacts, dirty, orders, people, strip_sql, tables, with_views
from burnish.queries.quality import issue_sql
from burnish.queries.registry import query, read

# --- statistics per group -------------------------------------------------------------------------------------

_GROUP_VALUE = {
    "mean": "avg(value) OVER (PARTITION BY user_id)",
    "median": "quantile_cont(value, 0.5) OVER (PARTITION BY user_id)",
    "mode": "(SELECT g.value FROM gaps g WHERE g.user_id IS NOT DISTINCT FROM gaps.user_id AND g.value IS NOT NULL "
    "GROUP BY g.value ORDER BY count(*) DESC, g.value LIMIT 1)",
}


def _fill_by_group(strategy: str, value: str) -> None:
    sql = f"SELECT event_id, user_id, round(coalesce(value, {value}), 6) AS value FROM gaps"

    @query(f"fill_missing_{strategy}_by_group", with_views(sql, "gaps"))
    def _(spark, sf):
        filled = fill_missing(dirty(spark, sf, "gaps"), "value", strategy, partition_by=["user_id"])
        return filled.withColumn("value", F.round("value", 6))


for _strategy, _value in _GROUP_VALUE.items():
    _fill_by_group(_strategy, _value)

_FENCES = (
    "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS low, quantile_cont(value, 0.75) AS high, avg(value) AS m, "
    "stddev_samp(value) AS s FROM events GROUP BY event_type), "
    "b AS (SELECT event_type, low - 1.5 * (high - low) AS lo, high + 1.5 * (high - low) AS hi, m - 2 * s AS zl, m + 2 * s AS zh FROM q) "
)


def _events(spark, sf):
    return read(spark, sf, "events").select("event_id", "event_type", "value")


@query(
    "clip_iqr_by_group",
    f"{_FENCES} SELECT event_id, event_type, round(least(greatest(value, lo), hi), 6) AS value FROM events JOIN b USING (event_type)",
)
def _(spark, sf):
    return clip_outliers(_events(spark, sf), "value", partition_by=["event_type"]).withColumn("value", F.round("value", 6))


@query(
    "clip_zscore_by_group",
    f"{_FENCES} SELECT event_id, event_type, round(least(greatest(value, zl), zh), 6) AS value FROM events JOIN b USING (event_type)",
)
def _(spark, sf):
    clipped = clip_outliers(_events(spark, sf), "value", "zscore", 2, partition_by=["event_type"])
    return clipped.withColumn("value", F.round("value", 6))


@query(
    "drop_outliers_by_group",
    f"{_FENCES} SELECT event_id, event_type, value FROM events JOIN b USING (event_type) WHERE value BETWEEN lo AND hi",
)
def _(spark, sf):
    return clip_outliers(_events(spark, sf), "value", "drop", partition_by=["event_type"])


# --- merges ---------------------------------------------------------------------------------------------------


@query(
    "merge_report",
    with_views(
        "SELECT (SELECT count(*) FROM dirty_people) AS left_rows, (SELECT count(*) FROM dirty_orders) AS right_rows, "
        "count(*) FILTER (n > 0) AS matched_left, count(*) FILTER (n = 0) AS unmatched_left, "
        "(SELECT count(*) FROM dirty_orders WHERE customer_id IS NULL OR customer_id NOT IN (SELECT id FROM dirty_people)) AS unmatched_right, "
        "count(DISTINCT id) FILTER (n > 1) AS repeated_keys, CAST(coalesce(sum(n - 1) FILTER (n > 0), 0) AS BIGINT) AS multiplied_rows "
        "FROM (SELECT id, (SELECT count(*) FROM dirty_orders o WHERE o.customer_id = p.id) AS n FROM dirty_people p)",
        "dirty_people", "dirty_orders",
    ),
)
def _(spark, sf):
    """What merging the orders into the people would do."""
    return merge_report(dirty(spark, sf, "dirty_people"), "orders", "id", "customer_id", {"orders": dirty(spark, sf, "dirty_orders")})


# --- padding --------------------------------------------------------------------------------------------------

TEXTS = ("name", "department", "salary", "email")


def _padded_sql(column: str) -> str:
    source = f"(SELECT count(*) FILTER ({column} <> {strip_sql(column)}) AS n FROM dirty_people)"
    return issue_sql("format_violation", column, "'medium'", "printf('%d values do not match the format', n)", "n", source)


@query("detect_padding", people(" UNION ALL ".join(_padded_sql(c) for c in TEXTS)))
def _(spark, sf):
    return detect_padding(dirty(spark, sf, "dirty_people"))


@query("mend_padding", people(f"SELECT * REPLACE ({', '.join(f'{strip_sql(c)} AS {c}' for c in TEXTS)}) FROM dirty_people"))
def _(spark, sf):
    """Padding found, a step recommended for each column, and the steps run."""
    df = dirty(spark, sf, "dirty_people")
    steps = steps_of(recommend_actions(detect_padding(df), df, {c: "stripped" for c in TEXTS}))
    return run_plan(df, steps).df


# --- rows of scorecards ---------------------------------------------------------------------------------------


@query(
    "scorecard_components",
    orders(
        "SELECT component, weight, score, round(weight * score, 6) AS weighted FROM ("
        "SELECT 'references' AS component, 0.5::DOUBLE AS weight, round(count(*) FILTER (customer_id IN "
        "(SELECT customer_id FROM dirty_customers)) / CAST(count(*) AS DOUBLE), 4) AS score FROM dirty_orders UNION ALL "
        "SELECT 'copies', 0.3::DOUBLE, round(1 - (count(*) - (SELECT count(*) FROM (SELECT DISTINCT customer_id, product, "
        "order_date FROM dirty_orders))) / CAST(count(*) AS DOUBLE), 4) FROM dirty_orders UNION ALL "
        f"SELECT 'product', 0.2::DOUBLE, round(count(*) FILTER (product = {strip_sql('product')}) / CAST(count(product) AS DOUBLE), 4) "
        "FROM dirty_orders)"
    ),
)
def _(spark, sf):
    """A scorecard of measures that are tables of one row, and of an aggregate."""
    df = dirty(spark, sf, "dirty_orders")
    card = scorecard_generic(
        df,
        {
            "references": (0.5, score_fk(df, "customer_id", "customers", "customer_id", tables(spark, sf))),
            "copies": (0.3, score_dedup(df, ["customer_id", "product", "order_date"])),
            "product": (0.2, stripped(df, "product")),
        },
    )
    return card.withColumn("weighted", F.round("weighted", 6))


_PHONE = r"regexp_matches(phone, '^\(\d{3}\) \d{3}-\d{4}$')"


@query(
    "scorecard_breakdown",
    contacts(
        "SELECT 'phone' AS component, 0.2::DOUBLE AS weight, round(count(*) FILTER "
        f"({_PHONE}) / CAST(count(phone) AS DOUBLE), 4) AS score FROM dirty_contacts"
    ),
)
def _(spark, sf):
    """One of the rows into which the scorecard of contacts breaks down."""
    rows = breakdown(scorecard_contacts(dirty(spark, sf, "dirty_contacts")), CONTACT_WEIGHTS)
    return rows.where("component = 'phone'").drop("weighted")


# --- plans in replies -----------------------------------------------------------------------------------------

_KNOWN = "'view', 'click', 'purchase'"


def _replies(spark, sf):
    """A reply per event; the events of a user are a conversation that holds a plan."""
    kind = F.col("event_type")
    upper = '{"action_type": "standardize_text", "parameters": {"column": "name", "operations": ["upper"]}}'
    young = '```json\n{"action_type": "drop_rows_by_condition", "parameters": {"column": "age", "operator": ">", "value": 60}}\n```'
    known = '{"action_type": "drop_rows_by_condition", "parameters": {"column": "age", "operator": "isnull"}}'
    other = '{"action_type": "polish", "parameters": {}}'
    reply = F.when(kind == "view", upper).when(kind == "click", young).when(kind == "purchase", known).when(kind == "error", other).otherwise("Done.")
    return parse_actions(read(spark, sf, "events").select("user_id", "event_id", reply.alias("reply")), "reply")


_PLANS = (
    "SELECT user_id, count(*) AS replies, count(*) FILTER (event_type <> 'signup') AS steps, "
    f"count(*) FILTER (event_type IN ({_KNOWN})) AS known_steps FROM events GROUP BY user_id"
)


@query("reply_plans", _PLANS)
def _(spark, sf):
    return reply_plans(_replies(spark, sf), ["user_id"])


@query(
    "plan_chosen_from_replies",
    people(
        "SELECT id, CASE WHEN 'view' IN (FROM kinds) THEN upper(name) ELSE name END AS name, age FROM dirty_people "
        "WHERE (age IS NOT NULL OR 'purchase' NOT IN (FROM kinds)) AND (age IS NULL OR age <= 60 OR 'click' NOT IN (FROM kinds))",
        more=f"plans AS ({_PLANS}), kinds AS (SELECT DISTINCT event_type FROM events WHERE user_id = "
        "(SELECT user_id FROM plans ORDER BY known_steps DESC, user_id LIMIT 1))",
    ),
)
def _(spark, sf):
    """The longest plan in the replies of any user, chosen before it is collected, and run over the people."""
    steps = best_plan(_replies(spark, sf), ["user_id"], ["event_id"])
    return run_plan(dirty(spark, sf, "dirty_people"), [*steps, step("drop_column", column="salary")]).df.select("id", "name", "age")
