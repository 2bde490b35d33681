"""Views that make the clean test tables dirty by key arithmetic; the same text runs in Spark and as an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burnish.queries.registry import read

PEOPLE = """
WITH b AS (SELECT c_custkey AS k, c_mktsegment AS seg, 35000 + (c_custkey * 7919) % 85000 AS sal,
  CASE c_nationkey % 5 WHEN 0 THEN 'Alice Smith' WHEN 1 THEN 'Mary-Jane O''Brien' WHEN 2 THEN 'Karen Wilson'
    WHEN 3 THEN 'Victor Garcia' ELSE 'Uma Clark' END AS nm
  FROM customer),
d AS (SELECT k AS id,
  CASE k % 3 WHEN 0 THEN upper(nm) WHEN 1 THEN lower(nm) ELSE nm END AS name,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(22 + k % 43 AS DOUBLE) END AS age,
  CASE WHEN k % 8 = 0 THEN '  ' || seg || '  ' ELSE seg END AS department,
  CASE WHEN k % 10 = 0 THEN NULL ELSE '$' || CAST(CAST(floor(sal / 1000.0) AS BIGINT) AS STRING) || ','
    || lpad(CAST(sal % 1000 AS STRING), 3, '0') || '.00' END AS salary,
  CASE WHEN k % 9 = 0 THEN NULL WHEN k % 5 = 0 THEN 'USER' || CAST(k AS STRING) || '@EXAMPLE.COM'
    WHEN k % 5 = 1 THEN '  user' || CAST(k AS STRING) || '@example.com  '
    ELSE 'user' || CAST(k AS STRING) || '@example.com' END AS email
  FROM b)
SELECT * FROM d UNION ALL SELECT * FROM d WHERE id % 13 = 0
"""

CONTACTS = """
WITH b AS (SELECT c_custkey AS k, CAST(200 + c_custkey % 800 AS STRING) AS a,
  CAST(200 + (c_custkey * 31) % 800 AS STRING) AS p, CAST(1000 + (c_custkey * 17) % 9000 AS STRING) AS l,
  1950 + c_custkey % 54 AS y, 1 + c_custkey % 12 AS m, 1 + c_custkey % 28 AS dd,
  CASE c_nationkey % 3 WHEN 0 THEN 'mary-jane' WHEN 1 THEN 'BOB' ELSE 'Charlie' END AS f,
  CASE c_nationkey % 4 WHEN 0 THEN 'o''brien' WHEN 1 THEN 'JONES' ELSE 'Smith' END AS ln FROM customer),
s AS (SELECT *, CAST(y AS STRING) AS ys, lpad(CAST(m AS STRING), 2, '0') AS ms, lpad(CAST(dd AS STRING), 2, '0') AS ds,
  substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST((m - 1) * 3 + 1 AS INT), 3) AS mon FROM b)
SELECT k AS contact_id, f AS first_name, ln AS last_name,
  CASE k % 6 WHEN 0 THEN '(' || a || ') ' || p || '-' || l WHEN 1 THEN a || '-' || p || '-' || l
    WHEN 2 THEN a || '.' || p || '.' || l WHEN 3 THEN a || p || l
    WHEN 4 THEN '+1 (' || a || ') ' || p || '-' || l ELSE p || '-' || l END AS phone,
  CASE WHEN k % 10 = 0 THEN 'USER' || CAST(k AS STRING) || '@EXAMPLE.COM'
    WHEN k % 10 = 1 THEN '  user' || CAST(k AS STRING) || '@example.com  '
    ELSE 'user' || CAST(k AS STRING) || '@example.com' END AS email,
  CASE k % 5 WHEN 0 THEN ys || '-' || ms || '-' || ds WHEN 1 THEN ms || '/' || ds || '/' || ys
    WHEN 2 THEN ds || '-' || ms || '-' || ys WHEN 3 THEN mon || ' ' || ds || ', ' || ys ELSE 'n/a' END AS birth_date,
  CAST(10000 + (k * 37) % 90000 AS STRING) || CASE k % 6 WHEN 4 THEN '-1234' WHEN 5 THEN '-5678' ELSE '' END AS zip_code,
  CASE k % 9 WHEN 0 THEN 'US' WHEN 1 THEN 'us' WHEN 2 THEN 'Us' WHEN 3 THEN 'USA' WHEN 4 THEN 'CA' WHEN 5 THEN 'ca'
    WHEN 6 THEN 'Ca' WHEN 7 THEN 'UK' ELSE 'uk' END AS country
FROM s
"""

ORDERS = """
WITH d AS (SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS customer_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'Kettle' WHEN 1 THEN 'Lamp' WHEN 2 THEN 'Chair' WHEN 3 THEN 'Blender'
    ELSE 'Keyboard' END AS product,
  o_totalprice * CASE WHEN o_orderkey % 20 = 3 THEN 32 ELSE 1 END AS price,
  CAST((1 + o_orderkey % 19) * CASE WHEN o_orderkey % 20 = 11 THEN 32 ELSE 1 END AS BIGINT) AS quantity,
  CAST(o_orderdate AS DATE) AS order_date FROM orders)
SELECT * FROM d UNION ALL
SELECT order_id + 10000000, customer_id, product, price, quantity, order_date FROM d WHERE order_id % 12 = 0
"""

CUSTOMERS = """
SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment,
  CASE c_nationkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'UK' ELSE 'AU' END AS country FROM customer
"""

# Events of which every third lost its value.
GAPS = "SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events"

# Replies that hold a step as JSON: bare, in a fence with words around it, cut off, or followed by more.
REPLIES = """
SELECT event_id, CASE event_id % 5
  WHEN 0 THEN '{"action_type": "' || event_type || '", "parameters": ' || props || '}'
  WHEN 1 THEN 'Next step:' || chr(10) || '```json' || chr(10) || '{"action_type": "' || event_type || '", "parameters": '
    || props || '}' || chr(10) || '```' || chr(10) || 'Done.'
  WHEN 2 THEN '  ```' || '{"action_type": "' || event_type || '"}' || '```'
  WHEN 3 THEN '{"action_type": "' || event_type || '", "parameters": ' || props
  ELSE '{"action_type": "' || event_type || '"} and so on' END AS reply
FROM events
"""

# Dates as text, their day first under slashes and their month first under dashes.
SPLIT_DATES = """
WITH d AS (SELECT o_orderkey AS k, CAST(day(o_orderdate) AS STRING) AS dd, CAST(month(o_orderdate) AS STRING) AS mm,
  CAST(year(o_orderdate) AS STRING) AS yy FROM orders)
SELECT k, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN dd || '/' || mm || '/' || yy ELSE mm || '-' || dd || '-' || yy END AS day
FROM d
"""

# Numbers, truth values and dates that are stored as text.
STORED_AS_TEXT = """
SELECT o_orderkey AS k, ' ' || CAST(o_custkey AS STRING) AS customer, CAST(o_custkey % 8 AS STRING) || '.5' AS half,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS regular,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, '$' || CAST(o_custkey AS STRING) || '.00' AS due,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING) ELSE 'none' END AS note,
  CAST(o_custkey AS DOUBLE) AS points, CAST(NULL AS STRING) AS nothing
FROM orders
"""

VIEWS = {
    "dirty_people": (PEOPLE, "customer"),
    "dirty_contacts": (CONTACTS, "customer"),
    "dirty_orders": (ORDERS, "orders"),
    "dirty_customers": (CUSTOMERS, "customer"),
    "gaps": (GAPS, "events"),
    "replies": (REPLIES, "events"),
    "split_dates": (SPLIT_DATES, "orders"),
    "stored_as_text": (STORED_AS_TEXT, "orders"),
}


def dirty(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A dirty view as a DataFrame."""
    text, source = VIEWS[view]
    escaped = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(escaped.replace(f"FROM {source}", "FROM {source}"), source=read(spark, sf_dir, source))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The auxiliary tables that the queries on dirty orders refer to."""
    return {"customers": dirty(spark, sf_dir, "dirty_customers")}


def with_views(select: str, *views: str, more: str = "") -> str:
    """Oracle SQL: the dirty views as common table expressions in front of a statement."""
    parts = [f"{v} AS ({VIEWS[v][0]})" for v in views] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {select}"


def people(select: str, more: str = "") -> str:
    return with_views(select, "dirty_people", more=more)


def contacts(select: str, more: str = "") -> str:
    return with_views(select, "dirty_contacts", more=more)


def orders(select: str, more: str = "") -> str:
    return with_views(select, "dirty_orders", "dirty_customers", more=more)


def number_sql(x: str) -> str:
    """Text as a number, null if it is none."""
    return (
        rf"CASE WHEN regexp_matches({x}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') THEN TRY_CAST(trim({x}) AS DOUBLE) END"
    )


def money_sql(x: str) -> str:
    """Currency text as a number."""
    return number_sql(f"regexp_replace({x}, '[$,€£]', '', 'g')")


def title_sql(x: str) -> str:
    """Title case that restarts at every non-letter."""
    return (
        rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|\P{{L}}+'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def date_sql(x: str) -> str:
    tries = [f"try_strptime({x}, '{f}')" for f in ("%Y-%m-%d", "%m/%d/%Y", "%d-%m-%Y", "%b %d, %Y")]
    return f"coalesce({', '.join(tries)})"


def fences_sql(x: str, k: float = 1.5) -> tuple[str, str]:
    """The interquartile bounds of a column as two aggregates."""
    q1, q3 = f"quantile_cont({x}, 0.25)", f"quantile_cont({x}, 0.75)"
    return f"{q1} - {k} * ({q3} - {q1})", f"{q3} + {k} * ({q3} - {q1})"
