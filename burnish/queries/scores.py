"""Quality scores and scorecards, and the downstream model."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.operators.references import merge_tables
from burnish.quality.regression import downstream_r2, label_encode
from burnish.quality.scores import (
    CONTACT_PATTERNS,
    CONTACT_WEIGHTS,
    CUSTOMER_WEIGHTS,
    ORDER_WEIGHTS,
    completeness,
    currency_numeric,
    integer_type,
    matches,
    score,
    score_dedup,
    score_fk,
    score_outlier_removal,
    scorecard_contacts,
    scorecard_customers,
    scorecard_generic,
    scorecard_orders,
    stripped,
    title_case,
    type_correctness,
)
from burnish.plans.recipes import ORDER_CONTENT
from burnish.queries.dirty import contacts, dirty, fences_sql, number_sql, orders, people, strip_sql, tables, title_sql
from burnish.queries.registry import query

CONTENT = ", ".join(ORDER_CONTENT)


def share_sql(condition: str, among: str = "true") -> str:
    return (
        f"coalesce(count(*) FILTER (({condition}) AND ({among})) / nullif(CAST(count(*) FILTER ({among}) AS DOUBLE), 0), 0.0)"
    )


COMPLETE = "(count(age) + count(salary) + count(email)) / (3.0::DOUBLE * count(*))"
MONEY = (
    f"({share_sql('(' + number_sql('salary') + ') IS NOT NULL')} + "
    + share_sql("NOT coalesce(regexp_matches(salary, '[$,€£]'), false)")
    + ") / 2"
)
WHOLE = f"({share_sql('age IS NOT NULL')} + {share_sql('age % 1 = 0', 'age IS NOT NULL')}) / 2"
TYPES = f"(({MONEY}) + ({WHOLE})) / 2"
UNIQUE = "(SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_people)) / CAST(count(*) AS DOUBLE)"
TITLE = share_sql(f"name = {title_sql('name')}", "name IS NOT NULL")
STRIPPED = share_sql(f"department = {strip_sql('department')}", "department IS NOT NULL")


def _single(name: str, column: str, sql: str, build) -> None:
    @query(name, people(f"SELECT round({sql}, 4) AS {column} FROM dirty_people"))
    def _(spark, sf):
        df = dirty(spark, sf, "dirty_people")
        return score(df, column, build(df))


_single("score_completeness", "completeness", COMPLETE, lambda df: completeness(df, ["age", "salary", "email", "none"]))
_single("score_currency_numeric", "currency_numeric", MONEY, lambda df: currency_numeric(df, "salary"))
_single("score_integer_type", "integer_type", WHOLE, lambda df: integer_type(df, "age"))
_single("score_type_correctness", "type_correctness", TYPES, type_correctness)
_single("score_title_case", "title_case", TITLE, lambda df: title_case(df, "name"))
_single("score_stripped", "stripped", STRIPPED, lambda df: stripped(df, "department"))


@query("score_dedup", orders(f"SELECT round((SELECT count(*) FROM (SELECT DISTINCT {CONTENT} FROM dirty_orders)) "
                             "/ CAST(count(*) AS DOUBLE), 4) AS deduplication FROM dirty_orders"))
def _(spark, sf):
    return score_dedup(dirty(spark, sf, "dirty_orders"), ORDER_CONTENT)


def weighted_sql(weights: dict[str, float]) -> str:
    return "round(" + " + ".join(f"{w}::DOUBLE * {c}" for c, w in weights.items()) + ", 6)"


@query(
    "scorecard_customers",
    people(
        f"SELECT *, {weighted_sql(CUSTOMER_WEIGHTS)} AS overall FROM (SELECT round({COMPLETE}, 4) AS completeness, "
        f"round({TYPES}, 4) AS type_correctness, round({UNIQUE}, 4) AS deduplication, "
        f"round(({TITLE} + {STRIPPED}) / 2, 4) AS format_consistency FROM dirty_people)"
    ),
)
def _(spark, sf):
    return scorecard_customers(dirty(spark, sf, "dirty_people")).withColumn("overall", F.round("overall", 6))


PARTS = {
    c: share_sql(f"regexp_matches({c}, '{p}')", f"{c} IS NOT NULL") for c, p in CONTACT_PATTERNS.items()
}


def _pattern(name: str, column: str) -> None:
    @query(name, contacts(f"SELECT round({PARTS[column]}, 4) AS {column} FROM dirty_contacts"))
    def _(spark, sf):
        df = dirty(spark, sf, "dirty_contacts")
        return score(df, column, matches(df, column, CONTACT_PATTERNS[column]))


_pattern("score_phone", "phone")
_pattern("score_email", "email")
_pattern("score_iso_date", "birth_date")
_pattern("score_zip", "zip_code")
_pattern("score_country", "country")

NAMES = " + ".join(share_sql(f"{c} = {title_sql(c)}", f"{c} IS NOT NULL") for c in ("first_name", "last_name"))


@query(
    "scorecard_contacts",
    contacts(
        f"SELECT *, {weighted_sql(CONTACT_WEIGHTS)} AS overall FROM (SELECT "
        + ", ".join(f"round({s}, 4) AS {c}" for c, s in PARTS.items())
        + f", round(({NAMES}) / 2, 4) AS name_case FROM dirty_contacts)"
    ),
)
def _(spark, sf):
    return scorecard_contacts(dirty(spark, sf, "dirty_contacts")).withColumn("overall", F.round("overall", 6))


FK = (
    "round(count(*) FILTER (customer_id IN (SELECT customer_id FROM dirty_customers)) / CAST(count(*) AS DOUBLE), 4)"
)


@query("score_fk", orders(f"SELECT {FK} AS referential_integrity FROM dirty_orders"))
def _(spark, sf):
    return score_fk(dirty(spark, sf, "dirty_orders"), "customer_id", "customers", "customer_id", tables(spark, sf))


def _tamed_sql(column: str, table: str = "tamed") -> str:
    """The outlier measure of a column of a table, compared with the dirty orders."""
    low, high = fences_sql(f"CAST({column} AS DOUBLE)")
    bounds = f"SELECT {low} AS lo, {high} AS hi, min({column}) AS a, max({column}) AS z FROM dirty_orders"
    side = (
        "CASE WHEN {o} <= 0 THEN 1.0::DOUBLE ELSE least(greatest(1 - greatest({c}, 0) / CAST({o} AS DOUBLE), 0), 1) END"
    )
    above, below = side.format(o="z - hi", c="cz - hi"), side.format(o="lo - a", c="lo - ca")
    clean = f"SELECT min({column}) AS ca, max({column}) AS cz FROM {table}"
    return f"(SELECT ({above} + {below}) / 2 FROM ({bounds}), ({clean}))"


TAMED = "tamed AS (SELECT * FROM dirty_orders WHERE price < 2000000 AND quantity < 200)"


def outliers_sql(table: str = "tamed") -> str:
    return f"round(({_tamed_sql('price', table)} + {_tamed_sql('quantity', table)}) / 2, 4)"


OUTLIERS = outliers_sql()


def tamed(spark, sf):
    """Orders without the most extreme ones."""
    return dirty(spark, sf, "dirty_orders").where("price < 2000000 AND quantity < 200")


@query("score_outlier_removal", orders(f"SELECT {OUTLIERS} AS outlier_removal", more=TAMED))
def _(spark, sf):
    return score_outlier_removal(tamed(spark, sf), dirty(spark, sf, "dirty_orders"))


def fit_sql(source: str, name: str = "fit") -> str:
    """R² by taking one regressor after the other out of the remaining ones.

    What the rest of a regressor explains on its own adds up to what all regressors explain together.
    """
    names = ("x1", "x2", "x3", "x4")
    parts, previous = [f"{name}0 AS ({source})"], f"{name}0"
    for i in range(1, 4):
        base = names[i - 1]
        rest = ", ".join(
            f"{n} - (SELECT regr_intercept({n}, {base}) FROM {previous}) "
            f"- (SELECT regr_slope({n}, {base}) FROM {previous}) * {base} AS {n}"
            for n in names[i:]
        )
        parts.append(f"{name}{i} AS (SELECT y, {', '.join(names[:i])}, {rest} FROM {previous})")
        previous = f"{name}{i}"
    terms = " + ".join(f"coalesce(power(CASE WHEN var_pop({n}) > 1e-12 THEN corr(y, {n}) END, 2), 0)" for n in names)
    return f"{', '.join(parts)}, {name} AS (SELECT {terms} AS r2 FROM {previous})"


SEGMENTED = (
    "merged AS (SELECT o.*, c.segment FROM dirty_orders o LEFT JOIN dirty_customers c ON o.customer_id = c.customer_id)"
)
ENCODED = (
    "SELECT price * quantity AS y, price AS x1, CAST(quantity AS DOUBLE) AS x2, "
    "CAST(dense_rank() OVER (ORDER BY product) - 1 AS DOUBLE) AS x3, "
    "CAST(dense_rank() OVER (ORDER BY coalesce(segment, 'nan')) - 1 AS DOUBLE) AS x4 FROM merged"
)


def merged(spark, sf):
    """Orders with their customers' segment."""
    return merge_tables(
        dirty(spark, sf, "dirty_orders"), "customers", "customer_id", "customer_id", "left", ["segment"], tables(spark, sf)
    )


@query(
    "label_encode",
    orders(
        "SELECT order_id, segment, CAST(code AS INT) AS segment_enc FROM merged JOIN codes "
        "ON coalesce(segment, 'nan') = label",
        more=f"{SEGMENTED}, codes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code "
        "FROM (SELECT DISTINCT coalesce(segment, 'nan') AS label FROM merged))",
    ),
)
def _(spark, sf):
    return label_encode(merged(spark, sf).select("order_id", "segment"), "segment", "segment_enc")


@query("downstream_r2", orders("SELECT round(r2, 6) AS r2 FROM fit", more=f"{SEGMENTED}, {fit_sql(ENCODED)}"))
def _(spark, sf):
    return spark.createDataFrame([(round(downstream_r2(merged(spark, sf)), 6),)], "r2 double")


@query("score_downstream_r2", orders("SELECT round(r2, 4) AS downstream_ml FROM fit", more=f"{SEGMENTED}, {fit_sql(ENCODED)}"))
def _(spark, sf):
    return spark.createDataFrame([(round(downstream_r2(merged(spark, sf)), 4),)], "downstream_ml double")


def features_sql(table: str, segment: str = "0") -> str:
    """What the model for a table of orders is fitted on."""
    return (
        "SELECT price * CAST(quantity AS DOUBLE) AS y, price AS x1, CAST(quantity AS DOUBLE) AS x2, "
        f"CAST(dense_rank() OVER (ORDER BY product) - 1 AS DOUBLE) AS x3, CAST({segment} AS DOUBLE) AS x4 FROM {table}"
    )


def order_parts_sql(table: str, fit: str) -> str:
    """The components of the scorecard of a table of orders."""
    return (
        f"(SELECT {FK} FROM {table}) AS referential_integrity, "
        f"(SELECT round((SELECT count(*) FROM (SELECT DISTINCT {CONTENT} FROM {table})) / CAST(count(*) AS DOUBLE), 4) "
        f"FROM {table}) AS deduplication, {outliers_sql(table)} AS outlier_removal, "
        f"(SELECT round(r2, 4) FROM {fit}) AS downstream_ml"
    )


@query(
    "scorecard_orders",
    orders(
        f"SELECT *, {weighted_sql(ORDER_WEIGHTS)} AS overall FROM (SELECT {order_parts_sql('tamed', 'fit')})",
        more=f"{TAMED}, {fit_sql(features_sql('tamed'))}",
    ),
)
def _(spark, sf):
    card = scorecard_orders(tamed(spark, sf), dirty(spark, sf, "dirty_customers"), dirty(spark, sf, "dirty_orders"))
    return card.withColumn("overall", F.round("overall", 6))


GENERIC = {"phone": 0.5, "zip_code": 0.3, "country": 0.2}


@query(
    "scorecard_generic",
    contacts(
        " UNION ALL ".join(
            f"SELECT '{c}' AS component, {w}::DOUBLE AS weight, s AS score, round({w}::DOUBLE * s, 6) AS weighted "
            f"FROM (SELECT round({PARTS[c]}, 4) AS s FROM dirty_contacts)"
            for c, w in GENERIC.items()
        )
    ),
)
def _(spark, sf):
    df = dirty(spark, sf, "dirty_contacts")
    card = scorecard_generic(df, {c: (w, matches(df, c, CONTACT_PATTERNS[c])) for c, w in GENERIC.items()})
    return card.withColumn("weighted", F.round("weighted", 6))
