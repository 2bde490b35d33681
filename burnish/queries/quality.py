"""Profiles and issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.quality.profile import (
    column_profile,
    dataset_stats,
    detect_currency,
    detect_duplicates,
    detect_fk,
    detect_float_as_int,
    detect_format_violation,
    detect_issues,
    detect_missing,
    detect_outliers,
    detect_schema_mismatch,
)
from burnish.queries.dirty import contacts, dirty, fences_sql, orders, people, tables, title_sql
from burnish.queries.registry import ORACLES, query, read

PEOPLE = ("id", "name", "age", "department", "salary", "email")
TEXTS = ("name", "department", "salary", "email")
TYPES = {"id": "bigint", "age": "double"}
# The schema that clean contacts have.
CONTACT_SCHEMA = {
    "first_name": {"dtype": "string", "format": "title_case"},
    "last_name": {"dtype": "string", "format": "title_case"},
    "phone": {"dtype": "string", "format": r"^\(\d{3}\) \d{3}-\d{4}$"},
    "email": {"dtype": "string", "format": r"^[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z]{2,}$"},
    "birth_date": {"dtype": "datetime", "format": "%Y-%m-%d"},
    "zip_code": {"dtype": "string", "format": r"^\d{5}$"},
    "country": {"dtype": "string", "format": "upper_case"},
}


def issue_sql(kind: str, column: str | None, severity: str, description: str, affected: str, source: str) -> str:
    """An issue row; it is left out where no row is affected."""
    name = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT '{kind}' AS issue_type, {name} AS \"column\", {severity} AS severity, {description} AS description, "
        f"CAST({affected} AS BIGINT) AS affected_rows FROM {source} WHERE {affected} > 0"
    )


def missing_sql(column: str) -> str:
    source = f"(SELECT count(*) - count({column}) AS n, count(*) AS total FROM dirty_people)"
    text = "printf('%d missing values (%.1f%%)', n, 100.0::DOUBLE * n / total)"
    return issue_sql(
        "missing_values", column, "CASE WHEN n::DOUBLE / total > 0.10 THEN 'high' ELSE 'medium' END", text, "n", source
    )


COPIES = issue_sql(
    "duplicate_rows", None, "'medium'", "printf('%d duplicate rows detected', n)", "n",
    "(SELECT (SELECT count(*) FROM dirty_people) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_people)) AS n)",
)


def money_sql(column: str) -> str:
    source = f"(SELECT count(*) FILTER (regexp_matches({column}, '[$,€£]')) AS n FROM dirty_people)"
    text = f"'''{column}'' contains ' || n || ' currency-formatted strings; expected numeric'"
    return issue_sql("wrong_dtype", column, "'high'", text, "n", source)


MISSING = " UNION ALL ".join(missing_sql(c) for c in PEOPLE)
MONEY = " UNION ALL ".join(money_sql(c) for c in TEXTS)


@query("detect_missing", people(MISSING))
def _(spark, sf):
    return detect_missing(dirty(spark, sf, "dirty_people"))


@query("detect_duplicates", people(COPIES))
def _(spark, sf):
    return detect_duplicates(dirty(spark, sf, "dirty_people"))


@query("detect_currency", people(MONEY))
def _(spark, sf):
    return detect_currency(dirty(spark, sf, "dirty_people"))


@query("detect_issues", people(f"{MISSING} UNION ALL {COPIES} UNION ALL {MONEY}"))
def _(spark, sf):
    return detect_issues(dirty(spark, sf, "dirty_people"))


ORACLES["top_issues"] = people(
    f"SELECT * FROM ({MISSING} UNION ALL {COPIES} UNION ALL {MONEY}) "
    "ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, affected_rows DESC, \"column\" LIMIT 10"
)


@query(
    "detect_float_as_int",
    people(
        issue_sql(
            "wrong_dtype", "age", "'medium'", "'''age'' holds whole numbers stored as float'", "n",
            "(SELECT CASE WHEN count(*) FILTER (age % 1 <> 0) = 0 THEN count(age) ELSE 0 END AS n FROM dirty_people)",
        )
    ),
)
def _(spark, sf):
    return detect_float_as_int(dirty(spark, sf, "dirty_people"))


def _breaks(column: str, rule: str) -> str:
    if rule == "title_case":
        return f"{column} <> {title_sql(column)}"
    if rule == "upper_case":
        return f"{column} <> upper({column})"
    if rule == "%Y-%m-%d":
        return f"coalesce(strftime(try_strptime({column}, '{rule}'), '{rule}') <> {column}, true)"
    return f"NOT regexp_matches({column}, '{rule}')"


@query(
    "detect_format_violation",
    contacts(
        " UNION ALL ".join(
            issue_sql(
                "format_violation", c, "'medium'", "printf('%d values do not match the format', n)", "n",
                f"(SELECT count(*) FILTER ({_breaks(c, s['format'])}) AS n FROM dirty_contacts)",
            )
            for c, s in CONTACT_SCHEMA.items()
        )
    ),
)
def _(spark, sf):
    formats = {c: s["format"] for c, s in CONTACT_SCHEMA.items()}
    return detect_format_violation(dirty(spark, sf, "dirty_contacts"), formats)


def _outliers(column: str) -> str:
    low, high = fences_sql(f"CAST({column} AS DOUBLE)")
    source = (
        f"(SELECT count(*) FILTER ({column} < lo OR {column} > hi) AS n FROM dirty_orders, "
        f"(SELECT {low} AS lo, {high} AS hi FROM dirty_orders))"
    )
    return issue_sql("outlier", column, "'medium'", "printf('%d values outside the interquartile bounds', n)", "n", source)


@query("detect_outliers", orders(f"{_outliers('price')} UNION ALL {_outliers('quantity')}"))
def _(spark, sf):
    return detect_outliers(dirty(spark, sf, "dirty_orders"), ["price", "quantity"])


@query(
    "detect_fk",
    orders(
        issue_sql(
            "referential_integrity", "customer_id", "'high'",
            "n || ' rows have no match in customers.customer_id'", "n",
            "(SELECT count(*) AS n FROM dirty_orders o WHERE NOT EXISTS "
            "(SELECT 1 FROM dirty_customers c WHERE c.customer_id = o.customer_id))",
        )
    ),
)
def _(spark, sf):
    return detect_fk(dirty(spark, sf, "dirty_orders"), "customer_id", "customers", "customer_id", tables(spark, sf))


@query(
    "detect_schema_mismatch",
    "WITH t AS (SELECT count(*) AS n FROM orders) "
    + " UNION ALL ".join(
        issue_sql("schema_mismatch", c, "'high'", f"'{text}'", "n", "t")
        for c, text in (
            ("o_orderkey", "type is bigint; expected float"), ("o_segment", "column is absent; expected string"),
            ("o_orderpriority", "type is string; expected int"),
        )
    ),
)
def _(spark, sf):
    target = {
        "o_orderkey": {"dtype": "float"}, "o_custkey": {"dtype": "int"}, "o_totalprice": {"dtype": "float"},
        "o_orderdate": {"dtype": "datetime"}, "o_segment": {"dtype": "string"}, "o_orderpriority": {"dtype": "int"},
    }
    return detect_schema_mismatch(read(spark, sf, "orders"), target)


def _profile(position: int, column: str) -> str:
    notes = ["CASE WHEN nulls > 0 THEN printf('missing_values (%d nulls, %.1f%%)', nulls, pct) END"]
    if column in TEXTS:
        notes.append("CASE WHEN money > 0 THEN 'currency_string — should be numeric' END")
    if column == "age":
        notes.append("CASE WHEN broken = 0 THEN 'stored_as_float — should be int' END")
    money = f"count(*) FILTER (regexp_matches({column}, '[$,€£]'))" if column in TEXTS else "0"
    broken = f"count(*) FILTER ({column} % 1 <> 0)" if column == "age" else "0"
    return (
        f"SELECT {position} AS position, '{column}' AS column_name, '{TYPES.get(column, 'string')}' AS dtype, "
        f"nulls AS null_count, pct AS null_pct, uniq AS unique_count, samples AS sample_values, "
        f"concat_ws('; ', {', '.join(notes)}) AS detected_issues FROM "
        f"(SELECT *, round(100.0::DOUBLE * nulls / total, 2) AS pct FROM (SELECT count(*) - count({column}) AS nulls, "
        f"count(*) AS total, count(DISTINCT {column}) AS uniq, {money} AS money, {broken} AS broken, "
        f"(SELECT string_agg(v, '|' ORDER BY id) FROM (SELECT id, CAST({column} AS VARCHAR) AS v FROM dirty_people "
        f"WHERE {column} IS NOT NULL ORDER BY id LIMIT 5)) AS samples FROM dirty_people))"
    )


@query("column_profile", people(" UNION ALL ".join(_profile(i, c) for i, c in enumerate(PEOPLE))))
def _(spark, sf):
    return column_profile(dirty(spark, sf, "dirty_people"), ["id"]).withColumns(
        {c: F.array_join(c, s) for c, s in (("sample_values", "|"), ("detected_issues", "; "))}
    )


LINE = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _line(position: int, column: str) -> str:
    order = ", ".join(LINE)
    return (
        f"SELECT {position} AS position, '{column}' AS column_name, '{LINE[column]}' AS dtype, "
        f"count(*) - count({column}) AS null_count, 0.0::DOUBLE AS null_pct, count(DISTINCT {column}) AS unique_count, "
        f"(SELECT string_agg(CAST({column} AS VARCHAR), '|' ORDER BY {order}) FROM "
        f"(SELECT * FROM lineitem ORDER BY {order} LIMIT 5)) AS sample_values, '' AS detected_issues FROM lineitem"
    )


@query("column_profile_lineitem", " UNION ALL ".join(_line(i, c) for i, c in enumerate(LINE)))
def _(spark, sf):
    return column_profile(read(spark, sf, "lineitem"), list(LINE)).withColumns(
        {c: F.array_join(c, s) for c, s in (("sample_values", "|"), ("detected_issues", "; "))}
    )


@query(
    "dataset_stats",
    people(
        "SELECT n AS total_rows, CAST(6 AS BIGINT) AS total_cols, missing AS missing_cells, "
        "round(100.0::DOUBLE * missing / (6 * n), 2) AS missing_pct, n - d AS duplicate_rows, wrong AS dtype_issues, "
        "wrong AS format_violations FROM (SELECT count(*) AS n, "
        "3 * count(*) - count(age) - count(salary) - count(email) AS missing, "
        "(SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_people)) AS d, "
        "CAST(1 + "
        + " + ".join(f"CAST(coalesce(bool_or(regexp_matches({c}, '[$,€£]')), false) AS INT)" for c in TEXTS)
        + " AS BIGINT) AS wrong FROM dirty_people)"
    ),
)
def _(spark, sf):
    return dataset_stats(dirty(spark, sf, "dirty_people"))
