"""Plans, their record, and recommended steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.plans.recipes import (
    ORDER_CONTENT,
    plan_contacts,
    plan_customers,
    plan_orders,
    step,
    truth_customers,
    truth_orders,
)
from burnish.plans.recommend import recommend_actions
from burnish.plans.runner import run_plan
from burnish.quality.profile import detect_issues
from burnish.quality.scores import ORDER_WEIGHTS, outlier_reference, scorecard_orders
from burnish.queries.dirty import (
    contacts,
    date_sql,
    dirty,
    fences_sql,
    money_sql,
    orders,
    people,
    strip_sql,
    title_sql,
)
from burnish.queries.quality import COPIES, MISSING, MONEY
from burnish.queries.registry import query
from burnish.queries.scores import features_sql, fit_sql, order_parts_sql

CONTENT = ", ".join(ORDER_CONTENT)

# --- people ---------------------------------------------------------------------------------------------------

UNIQUE_PEOPLE = f"u AS (SELECT DISTINCT * REPLACE ({money_sql('salary')} AS salary) FROM dirty_people)"
AGE_FILLED = "(SELECT quantile_cont(age, 0.5) FROM u)"
# A whole median lets the column become an integer; otherwise the cast fails and the column stays as it is.
CLEAN_PEOPLE = (
    f"SELECT id, {title_sql('name')} AS name, coalesce(age, {AGE_FILLED}) AS age, {strip_sql('department')} AS department, "
    "coalesce(salary, (SELECT quantile_cont(salary, 0.5) FROM u)) AS salary, coalesce(email, 'unknown@example.com') AS email "
    "FROM u"
)


def age_as_double(df):
    """Age as a double, whichever of the two types the plan arrived at."""
    return df.withColumn("age", F.col("age").cast("double"))


@query("plan_customers", people(CLEAN_PEOPLE, more=UNIQUE_PEOPLE))
def _(spark, sf):
    return age_as_double(plan_customers(dirty(spark, sf, "dirty_people")).df)


@query(
    "truth_customers",
    people(
        CLEAN_PEOPLE,
        more="k AS (SELECT *, row_number() OVER (PARTITION BY name, age, department, salary, email ORDER BY id) AS place "
        f"FROM dirty_people), u AS (SELECT * EXCLUDE (place) REPLACE ({money_sql('salary')} AS salary) FROM k WHERE place = 1)",
    ),
)
def _(spark, sf):
    return age_as_double(truth_customers(dirty(spark, sf, "dirty_people")))


# --- contacts -------------------------------------------------------------------------------------------------

_DIGITS = r"regexp_replace(phone, '\D', '', 'g')"
_LOCAL = f"right({_DIGITS}, 10)"


@query(
    "plan_contacts",
    contacts(
        f"SELECT contact_id, {title_sql('first_name')} AS first_name, {title_sql('last_name')} AS last_name, "
        f"CASE WHEN length({_DIGITS}) = 10 OR (length({_DIGITS}) = 11 AND {_DIGITS}[1] = '1') "
        f"THEN '(' || {_LOCAL}[1:3] || ') ' || {_LOCAL}[4:6] || '-' || {_LOCAL}[7:10] ELSE phone END AS phone, "
        f"{strip_sql('lower(email)')} AS email, strftime({date_sql('birth_date')}, '%Y-%m-%d') AS birth_date, "
        r"nullif(regexp_extract(zip_code, '(\d{5})', 1), '') AS zip_code, upper(country) AS country FROM dirty_contacts"
    ),
)
def _(spark, sf):
    return plan_contacts(dirty(spark, sf, "dirty_contacts")).df


# --- orders ---------------------------------------------------------------------------------------------------

_P, _Q = fences_sql("price"), fences_sql("CAST(quantity AS DOUBLE)")
LINKED = "linked AS (SELECT * FROM dirty_orders WHERE customer_id IN (SELECT customer_id FROM dirty_customers))"
CLEAN = (
    f"{LINKED}, once AS (SELECT *, row_number() OVER (PARTITION BY {CONTENT} ORDER BY order_id) AS place FROM linked), "
    f"clean AS (SELECT * EXCLUDE (place) FROM once WHERE place = 1), "
    f"fences AS (SELECT {_P[0]} AS pl, {_P[1]} AS ph, {_Q[0]} AS ql, {_Q[1]} AS qh FROM clean)"
)
CLEAN_ORDERS = (
    "SELECT order_id, o.customer_id, product, round(least(greatest(price, pl), ph), 6) AS price, "
    "round(least(greatest(CAST(quantity AS DOUBLE), ql), qh), 6) AS quantity, order_date, c.segment "
    "FROM clean o LEFT JOIN dirty_customers c ON o.customer_id = c.customer_id, fences"
)


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("price", "quantity")})


def clean_orders(spark, sf, **options):
    """The plan for orders on the dirty tables."""
    return plan_orders(dirty(spark, sf, "dirty_orders"), dirty(spark, sf, "dirty_customers"), **options)


@query("plan_orders", orders(CLEAN_ORDERS, more=CLEAN))
def _(spark, sf):
    return rounded(clean_orders(spark, sf).df)


@query("truth_orders", orders(CLEAN_ORDERS, more=CLEAN))
def _(spark, sf):
    return rounded(truth_orders(dirty(spark, sf, "dirty_orders"), dirty(spark, sf, "dirty_customers")))


# --- any plan -------------------------------------------------------------------------------------------------

# Three of these steps fail, and so must leave no trace.
MIXED = (
    step("rename_column", old_name="product", new_name="item"),
    step("polish", column="item"),
    step("cast_column", column="absent", dtype="int"),
    step("drop_rows_by_condition", column="quantity", operator=">", value=300),
    step("fill_missing", column="customer_id", strategy="constant", fill_value="nobody"),
    step("fill_missing", column="customer_id", strategy="constant", fill_value=-1),
    step("standardize_text", column="item", operations=["upper"]),
    step("drop_column", column="order_date"),
)


@query(
    "run_plan",
    orders(
        "SELECT order_id, coalesce(customer_id, -1) AS customer_id, upper(product) AS item, price, quantity "
        "FROM dirty_orders WHERE quantity <= 300"
    ),
)
def _(spark, sf):
    return run_plan(dirty(spark, sf, "dirty_orders"), MIXED).df


@query(
    "plan_audit",
    orders(
        "SELECT step, action_type, success, rows_before, rows_after, row_loss, greatest(0, rows_before - rows_after) AS rows_removed, "
        "greatest(0, rows_after - rows_before) AS rows_added, CASE step WHEN 3 THEN cp WHEN 4 THEN cq END AS cells_changed, "
        "CASE step WHEN 3 THEN 0 WHEN 4 THEN 0 END AS cells_filled, round(CASE step WHEN 3 THEN pl WHEN 4 THEN ql END, 6) AS lower_bound, "
        "round(CASE step WHEN 3 THEN ph WHEN 4 THEN qh END, 6) AS upper_bound, CASE step WHEN 5 THEN 'segment' ELSE '' END AS columns_added FROM "
        "(SELECT count(*) AS n0 FROM dirty_orders), (SELECT count(*) AS n1 FROM linked), (SELECT count(*) AS n2 FROM clean), fences, "
        "(SELECT count(*) FILTER (price < pl OR price > ph) AS cp, count(*) FILTER (quantity < ql OR quantity > qh) AS cq FROM clean, fences), "
        "(SELECT count(*) AS n5 FROM clean o LEFT JOIN dirty_customers c ON o.customer_id = c.customer_id), "
        "(VALUES (1, 'fix_referential_integrity'), (2, 'drop_duplicates'), (3, 'clip_outliers'), (4, 'clip_outliers'), "
        "(5, 'merge_tables')) s(step, action_type), "
        "LATERAL (SELECT true AS success, CASE step WHEN 1 THEN n0 WHEN 2 THEN n1 ELSE n2 END AS rows_before, "
        "CASE step WHEN 1 THEN n1 WHEN 5 THEN n5 ELSE n2 END AS rows_after), "
        "LATERAL (SELECT (rows_before - rows_after) / CAST(rows_before AS DOUBLE) > 0.30 AS row_loss)",
        more=CLEAN,
    ),
)
def _(spark, sf):
    record = clean_orders(spark, sf, audit=True).audit()
    return record.select(
        "step", "action_type", "success", "rows_before", "rows_after", "row_loss", "rows_removed", "rows_added", "cells_changed",
        "cells_filled", F.round("lower_bound", 6).alias("lower_bound"), F.round("upper_bound", 6).alias("upper_bound"),
        F.array_join("columns_added", ", ").alias("columns_added"),
    )


# The table after each step of the plan for orders.
STATES = {
    "dirty_orders": None,
    "linked": None,
    "clean": None,
    "priced": "SELECT * REPLACE (least(greatest(price, pl), ph) AS price) FROM clean, fences",
    "clipped": "SELECT * REPLACE (least(greatest(CAST(quantity AS DOUBLE), ql), qh) AS quantity) FROM priced",
    "final": "SELECT o.*, c.segment FROM clipped o LEFT JOIN dirty_customers c ON o.customer_id = c.customer_id",
}


def _rated(number: int, table: str) -> str:
    overall = "round(" + " + ".join(f"{w}::DOUBLE * {c}" for c, w in ORDER_WEIGHTS.items()) + ", 4)"
    return f"SELECT {number} AS step, {overall} AS rating FROM (SELECT {order_parts_sql(table, f'fit{number}_')})"


_FITS = ", ".join(
    fit_sql(features_sql(t, "dense_rank() OVER (ORDER BY coalesce(segment, 'nan')) - 1" if t == "final" else "0"), f"fit{i}_")
    for i, t in enumerate(STATES)
)


@query(
    "plan_audit_scores",
    orders(
        "SELECT a.step, b.rating AS score_before, a.rating AS score_after, round(a.rating - b.rating, 4) AS score_delta "
        "FROM ratings a JOIN ratings b ON a.step = b.step + 1",
        more=f"{CLEAN}, "
        + ", ".join(f"{t} AS ({sql})" for t, sql in STATES.items() if sql)
        + f", {_FITS}, ratings AS ({' UNION ALL '.join(_rated(i, t) for i, t in enumerate(STATES))})",
    ),
)
def _(spark, sf):
    customers = dirty(spark, sf, "dirty_customers")
    reference = outlier_reference(dirty(spark, sf, "dirty_orders"))

    def overall(df):
        return scorecard_orders(df, customers, reference).first()["overall"]

    record = clean_orders(spark, sf, score=overall).audit()
    return record.select("step", "score_before", "score_after", "score_delta")


@query(
    "row_loss_guard",
    orders(
        "SELECT *, (rows_before - rows_after) / CAST(rows_before AS DOUBLE) > 0.30 AS row_loss FROM ("
        "SELECT 1 AS step, count(*) AS rows_before, count(*) FILTER (product = 'Kettle') AS rows_after FROM dirty_orders "
        "UNION ALL SELECT 2, count(*), count(*) FILTER (quantity <= 15) FROM dirty_orders WHERE product = 'Kettle')"
    ),
)
def _(spark, sf):
    steps = (
        step("drop_rows_by_condition", column="product", operator="!=", value="Kettle"),
        step("drop_rows_by_condition", column="quantity", operator=">", value=15),
    )
    record = run_plan(dirty(spark, sf, "dirty_orders"), steps, audit=True).audit()
    return record.select("step", "rows_before", "rows_after", "row_loss")


@query(
    "recommend_actions",
    people(
        "SELECT CASE issue_type WHEN 'duplicate_rows' THEN 2 WHEN 'wrong_dtype' THEN 3 ELSE 5 END AS priority, "
        "CASE issue_type WHEN 'duplicate_rows' THEN 'drop_duplicates' WHEN 'wrong_dtype' THEN 'normalize_format' "
        "ELSE 'fill_missing' END AS action_type, \"column\", "
        "CASE WHEN issue_type = 'duplicate_rows' THEN '{}' WHEN issue_type = 'wrong_dtype' THEN "
        "'{\"column\":\"' || \"column\" || '\",\"format_type\":\"strip_currency\"}' "
        "WHEN \"column\" IN ('age', 'salary') THEN '{\"column\":\"' || \"column\" || '\",\"strategy\":\"median\"}' "
        "ELSE '{\"column\":\"' || \"column\" || '\",\"strategy\":\"constant\",\"fill_value\":\"unknown\"}' END AS parameters "
        f"FROM ({MISSING} UNION ALL {COPIES} UNION ALL {MONEY})"
    ),
)
def _(spark, sf):
    df = dirty(spark, sf, "dirty_people")
    return recommend_actions(detect_issues(df), df)
