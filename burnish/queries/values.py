"""Filling, formatting and clipping values, and reading steps out of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.operators.formats import apply_regex, normalize_format, standardize_text
from burnish.operators.missing import fill_missing
from burnish.operators.outliers import clip_outliers
from burnish.plans.responses import parse_actions
from burnish.queries.dirty import (
    contacts,
    date_sql,
    dirty,
    fences_sql,
    money_sql,
    people,
    strip_sql,
    title_sql,
    with_views,
)
from burnish.queries.registry import query, read

PEOPLE = ("id", "name", "age", "department", "salary", "email")
CONTACTS = ("contact_id", "first_name", "last_name", "phone", "email", "birth_date", "zip_code", "country")


def _people(**changed: str) -> str:
    picks = ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in PEOPLE)
    return people(f"SELECT {picks} FROM dirty_people")


def _contacts(**changed: str) -> str:
    picks = ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in CONTACTS)
    return contacts(f"SELECT {picks} FROM dirty_contacts")


# --- missing values -------------------------------------------------------------------------------------------


@query("fill_missing_mean", _people(age="round(coalesce(age, (SELECT avg(age) FROM dirty_people)), 6)"))
def _(spark, sf):
    filled = fill_missing(dirty(spark, sf, "dirty_people"), "age", "mean")
    return filled.withColumn("age", F.round("age", 6))


@query("fill_missing_median", _people(age="coalesce(age, (SELECT quantile_cont(age, 0.5) FROM dirty_people))"))
def _(spark, sf):
    return fill_missing(dirty(spark, sf, "dirty_people"), "age", "median")


@query(
    "fill_missing_mode",
    _people(
        salary="coalesce(salary, (SELECT salary FROM dirty_people WHERE salary IS NOT NULL "
        "GROUP BY salary ORDER BY count(*) DESC, salary LIMIT 1))"
    ),
)
def _(spark, sf):
    return fill_missing(dirty(spark, sf, "dirty_people"), "salary", "mode")


@query("fill_missing_constant", _people(email="coalesce(email, 'unknown@example.com')"))
def _(spark, sf):
    return fill_missing(dirty(spark, sf, "dirty_people"), "email", "constant", "unknown@example.com")


@query("fill_missing_unknown", _people(age="coalesce(CAST(age AS VARCHAR), 'unknown')"))
def _(spark, sf):
    return fill_missing(dirty(spark, sf, "dirty_people"), "age", "unknown")


# --- formats --------------------------------------------------------------------------------------------------

_DIGITS = r"regexp_replace(phone, '\D', '', 'g')"
_LOCAL = f"right({_DIGITS}, 10)"


@query(
    "normalize_phone",
    _contacts(
        phone=f"CASE WHEN length({_DIGITS}) = 10 OR (length({_DIGITS}) = 11 AND {_DIGITS}[1] = '1') "
        f"THEN '(' || {_LOCAL}[1:3] || ') ' || {_LOCAL}[4:6] || '-' || {_LOCAL}[7:10] ELSE phone END"
    ),
)
def _(spark, sf):
    return normalize_format(dirty(spark, sf, "dirty_contacts"), "phone", "phone")


@query("normalize_email", _contacts(email=strip_sql("lower(email)")))
def _(spark, sf):
    return normalize_format(dirty(spark, sf, "dirty_contacts"), "email", "email")


@query("normalize_date", _contacts(birth_date=f"strftime({date_sql('birth_date')}, '%d.%m.%Y')"))
def _(spark, sf):
    return normalize_format(dirty(spark, sf, "dirty_contacts"), "birth_date", "date", "%d.%m.%Y")


@query("text_case_lower", _people(name="lower(name)"))
def _(spark, sf):
    return normalize_format(dirty(spark, sf, "dirty_people"), "name", "text_case")


@query("text_case_upper", _contacts(country="upper(country)"))
def _(spark, sf):
    return normalize_format(dirty(spark, sf, "dirty_contacts"), "country", "text_case", "upper")


@query("text_case_title", _people(name=title_sql("name")))
def _(spark, sf):
    return normalize_format(dirty(spark, sf, "dirty_people"), "name", "text_case", "title")


@query("strip_currency", _people(salary=money_sql("salary")))
def _(spark, sf):
    return normalize_format(dirty(spark, sf, "dirty_people"), "salary", "strip_currency")


@query("normalize_zip", _contacts(zip_code=r"nullif(regexp_extract(zip_code, '(\d{5})', 1), '')"))
def _(spark, sf):
    return normalize_format(dirty(spark, sf, "dirty_contacts"), "zip_code", "zip_code")


# --- text -----------------------------------------------------------------------------------------------------


@query("apply_regex", _contacts(phone=r"regexp_replace(phone, '(\d{3})\D+(\d{4})$', '\2-$\1', 'g')"))
def _(spark, sf):
    return apply_regex(dirty(spark, sf, "dirty_contacts"), "phone", r"(?P<a>\d{3})\D+(\d{4})$", r"\2-$\g<a>")


@query("text_strip", _people(department=strip_sql("department")))
def _(spark, sf):
    return standardize_text(dirty(spark, sf, "dirty_people"), "department", ["strip"])


@query("text_lower", _people(email="lower(email)"))
def _(spark, sf):
    return standardize_text(dirty(spark, sf, "dirty_people"), "email", ["lower"])


@query("text_upper", _people(email="upper(email)"))
def _(spark, sf):
    return standardize_text(dirty(spark, sf, "dirty_people"), "email", ["upper"])


@query("text_title", _contacts(last_name=title_sql("last_name")))
def _(spark, sf):
    return standardize_text(dirty(spark, sf, "dirty_contacts"), "last_name", ["title"])


@query(
    "text_remove_extra_spaces",
    rf"SELECT doc_id, {strip_sql(r'''regexp_replace(text, '\s+', ' ', 'g')''')} AS text FROM documents",
)
def _(spark, sf):
    return standardize_text(read(spark, sf, "documents").select("doc_id", "text"), "text", ["remove_extra_spaces"])


@query("text_chain", _people(name=f"upper({strip_sql(title_sql('name'))})", department=strip_sql("lower(department)")))
def _(spark, sf):
    df = standardize_text(dirty(spark, sf, "dirty_people"), "name", ["title", "strip", "upper"])
    return standardize_text(df, "department", ["lower", "remove_extra_spaces"])


# --- outliers -------------------------------------------------------------------------------------------------

_LOW, _HIGH = fences_sql("value")


@query(
    "clip_iqr",
    f"WITH b AS (SELECT {_LOW} AS lo, {_HIGH} AS hi FROM events) "
    "SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, b",
)
def _(spark, sf):
    df = clip_outliers(read(spark, sf, "events").select("event_id", "value"), "value")
    return df.withColumn("value", F.round("value", 6))


@query(
    "clip_zscore",
    "WITH b AS (SELECT avg(value) - 2 * stddev_samp(value) AS lo, avg(value) + 2 * stddev_samp(value) AS hi FROM events) "
    "SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, b",
)
def _(spark, sf):
    df = clip_outliers(read(spark, sf, "events").select("event_id", "value"), "value", "zscore", 2)
    return df.withColumn("value", F.round("value", 6))


@query(
    "drop_outliers",
    f"WITH b AS (SELECT {_LOW} AS lo, {_HIGH} AS hi FROM events) SELECT events.* FROM events, b WHERE value BETWEEN lo AND hi",
)
def _(spark, sf):
    return clip_outliers(read(spark, sf, "events"), "value", "drop")


# --- steps in text --------------------------------------------------------------------------------------------


@query(
    "parse_action_json",
    with_views(
        "SELECT r.event_id, CASE WHEN r.event_id % 5 < 3 THEN event_type END AS action_type, "
        "CASE WHEN r.event_id % 5 < 2 THEN json_extract_string(props, '$.k') END AS k, "
        "CAST(CASE WHEN r.event_id % 5 < 2 THEN 1 WHEN r.event_id % 5 = 2 THEN 0 END AS INT) AS parameters "
        "FROM replies r JOIN events e ON r.event_id = e.event_id",
        "replies",
    ),
)
def _(spark, sf):
    steps = parse_actions(dirty(spark, sf, "replies"), "reply")
    return steps.select(
        "event_id", "action_type", F.try_element_at("parameters", F.lit("k")).alias("k"),
        F.when(F.col("parameters").isNotNull(), F.size("parameters")).alias("parameters"),
    )
