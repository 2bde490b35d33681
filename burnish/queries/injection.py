"""Dirty-data injection. The draws come from MD5, so the oracle makes the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.operators import inject
from burnish.queries.dirty import dirty, with_views
from burnish.queries.registry import query, read

SEED = inject.SEED


def u_sql(key: str, purpose: str) -> str:
    """A draw in [0, 1)."""
    digest = f"md5('{purpose}/{SEED}/' || CAST({key} AS VARCHAR))"
    return f"(CAST('0x' || substr({digest}, 1, 8) AS BIGINT) / 4294967296::DOUBLE)"


def whole_sql(u: str, low: int, high: int) -> str:
    return f"CAST(floor({u} * {high - low + 1}) + {low} AS BIGINT)"


def pick_sql(u: str, options) -> str:
    quoted = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"list_extract([{quoted}], {whole_sql(u, 1, len(options))})"


def customers_sql(**changed: str) -> str:
    cols = ("customer_id", "name", "segment", "country")
    picks = ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in cols)
    return with_views(f"SELECT {picks} FROM dirty_customers", "dirty_customers")


def orders_sql(**changed: str) -> str:
    cols = {"order_id": "o_orderkey", "customer_id": "o_custkey", "price": "o_totalprice"}
    return "SELECT " + ", ".join(f"{changed.get(c, e)} AS {c}" for c, e in cols.items()) + " FROM orders"


def orders(spark, sf):
    df = read(spark, sf, "orders")
    return df.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("price")
    )


def hit(key: str, share: float, purpose: str) -> str:
    return f"{u_sql(key, purpose)} < {share}::DOUBLE"


@query("inject_nulls", customers_sql(segment=f"CASE WHEN NOT {hit('customer_id', 0.15, 'null segment')} THEN segment END"))
def _(spark, sf):
    return inject.inject_nulls(dirty(spark, sf, "dirty_customers"), "segment", 0.15, "customer_id")


@query(
    "inject_whitespace",
    customers_sql(
        segment=f"CASE WHEN {hit('customer_id', 0.12, 'pad segment')} THEN '  ' || segment || '  ' ELSE segment END"
    ),
)
def _(spark, sf):
    return inject.inject_whitespace(dirty(spark, sf, "dirty_customers"), "segment", 0.12, "customer_id")


@query(
    "inject_case",
    customers_sql(
        name=f"CASE WHEN NOT {u_sql('customer_id', 'case name')} < 2::DOUBLE / 3 THEN name WHEN "
        f"{u_sql('customer_id', 'which case name')} < 0.5::DOUBLE THEN upper(name) ELSE lower(name) END"
    ),
)
def _(spark, sf):
    return inject.inject_case(dirty(spark, sf, "dirty_customers"), "name", "customer_id")


@query(
    "inject_spellings",
    customers_sql(country=pick_sql(u_sql("customer_id", "spelling country"), inject.COUNTRY_SPELLINGS)),
)
def _(spark, sf):
    return inject.inject_spellings(dirty(spark, sf, "dirty_customers"), "country", "customer_id", inject.COUNTRY_SPELLINGS)


@query("inject_currency", "SELECT p_partkey, '$' || format('{:,.2f}', p_retailprice) AS p_retailprice FROM part")
def _(spark, sf):
    return inject.inject_currency(read(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


@query("inject_int_as_float", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part")
def _(spark, sf):
    return inject.inject_int_as_float(read(spark, sf, "part").select("p_partkey", "p_size"), "p_size")


@query(
    "inject_duplicates",
    with_views(
        f"SELECT * FROM dirty_customers UNION ALL SELECT * FROM dirty_customers WHERE {hit('customer_id', 0.08, 'duplicate')}",
        "dirty_customers",
    ),
)
def _(spark, sf):
    return inject.inject_duplicates(dirty(spark, sf, "dirty_customers"), 0.08, "customer_id")


@query(
    "inject_near_duplicates",
    orders_sql() + " UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice FROM orders WHERE "
    + hit("o_orderkey", 0.08, "near duplicate"),
)
def _(spark, sf):
    return inject.inject_near_duplicates(orders(spark, sf), 0.08, "order_id", 10**9)


def choose_sql(u: str, options) -> str:
    cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {whole_sql(u, 0, len(options) - 1)} {cases} END"


def phone_sql(digits: str, u: str) -> str:
    a, b, c = f"{digits}[1:3]", f"{digits}[4:6]", f"{digits}[7:10]"
    return choose_sql(
        u,
        (
            f"'(' || {a} || ') ' || {b} || '-' || {c}", f"{a} || '-' || {b} || '-' || {c}",
            f"{a} || '.' || {b} || '.' || {c}", f"{a} || {b} || {c}", f"'+1 (' || {a} || ') ' || {b} || '-' || {c}",
        ),
    )


def date_sql(day: str, u: str) -> str:
    return choose_sql(u, [f"strftime({day}, '{f}')" for f in ("%Y-%m-%d", "%m/%d/%Y", "%d-%m-%Y", "%b %d, %Y")])


@query(
    "inject_phone_formats",
    "SELECT c_custkey, " + phone_sql("CAST(2000000000 + c_custkey AS VARCHAR)", u_sql("c_custkey", "layout phone"))
    + " AS phone FROM customer",
)
def _(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") + 2000000000).alias("phone"))
    return inject.inject_phone_formats(df, "phone", "c_custkey")


@query(
    "inject_date_formats",
    "SELECT o_orderkey, " + date_sql("o_orderdate", u_sql("o_orderkey", "layout o_orderdate"))
    + " AS o_orderdate FROM orders",
)
def _(spark, sf):
    return inject.inject_date_formats(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query(
    "inject_zip_suffix",
    "SELECT c_custkey, CAST(10000 + c_custkey % 90000 AS VARCHAR) || "
    + pick_sql(u_sql("c_custkey", "suffix zip"), inject.ZIP_SUFFIXES) + " AS zip FROM customer",
)
def _(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 90000 + 10000).alias("zip"))
    return inject.inject_zip_suffix(df, "zip", "c_custkey")


def outlier_sql(column: str, key: str, name: str, share: float, low: float, high: float) -> str:
    factor = f"({float(low)}::DOUBLE + {u_sql(key, 'factor ' + name)} * {float(high - low)}::DOUBLE)"
    return f"CASE WHEN {hit(key, share, 'outlier ' + name)} THEN {column} * {factor} ELSE {column} END"


@query(
    "inject_outliers",
    orders_sql(price=f"round({outlier_sql('o_totalprice', 'o_orderkey', 'price', 0.05, 10, 50)}, 4)"),
)
def _(spark, sf):
    df = inject.inject_outliers(orders(spark, sf), "price", 0.05, 10, 50, "order_id")
    return df.withColumn("price", F.round("price", 4))


@query(
    "inject_fk_violations",
    orders_sql(
        customer_id=f"CASE WHEN {hit('o_orderkey', 0.10, 'orphan customer_id')} "
        f"THEN {whole_sql(u_sql('o_orderkey', 'absent customer_id'), 10**6, 10**6 + 48)} ELSE o_custkey END"
    ),
)
def _(spark, sf):
    return inject.inject_fk_violations(orders(spark, sf), "customer_id", 0.10, 10**6, "order_id")


# --- whole tables ---------------------------------------------------------------------------------------------


def _name(key: str) -> tuple[str, str]:
    return pick_sql(u_sql(key, "first"), inject.FIRST_NAMES), pick_sql(u_sql(key, "last"), inject.LAST_NAMES)


def _mail(key: str) -> str:
    first, last = _name(key)
    return f"lower({first} || '.' || replace({last}, chr(39), '') || {whole_sql(u_sql(key, 'mailbox'), 1, 99)}) || '@example.com'"


_K = "c_custkey"
_FIRST, _LAST = _name(_K)
PEOPLE = f"""
WITH base AS (SELECT c_custkey AS id, {_FIRST} || ' ' || {_LAST} AS name, {whole_sql(u_sql(_K, 'age'), 22, 64)} AS age,
  {pick_sql(u_sql(_K, 'department'), inject.DEPARTMENTS)} AS department, {pick_sql(u_sql(_K, 'city'), inject.CITIES)} AS city,
  {whole_sql(u_sql(_K, 'salary'), 35000, 119999)} AS salary, {_mail(_K)} AS email FROM customer),
dirt AS (SELECT id,
  CASE WHEN NOT {u_sql('id', 'case name')} < 2::DOUBLE / 3 THEN name
    WHEN {u_sql('id', 'which case name')} < 0.5::DOUBLE THEN upper(name) ELSE lower(name) END AS name,
  CASE WHEN NOT {hit('id', 0.15, 'null age')} THEN CAST(age AS DOUBLE) END AS age,
  CASE WHEN {hit('id', 0.12, 'pad department')} THEN '  ' || department || '  ' ELSE department END AS department, city,
  CASE WHEN NOT {hit('id', 0.10, 'null salary')} THEN '$' || format('{{:,.2f}}', salary::DOUBLE) END AS salary,
  CASE WHEN NOT {hit('id', 0.12, 'null email')} THEN email END AS email FROM base)
SELECT * FROM dirt UNION ALL SELECT * FROM dirt WHERE {hit('id', 0.08, 'duplicate')}
"""


@query("gen_people", PEOPLE)
def _(spark, sf):
    return inject.gen_people(read(spark, sf, "customer"), "c_custkey")


_DAY = (
    f"make_date({whole_sql(u_sql(_K, 'year'), 1950, 2003)}, {whole_sql(u_sql(_K, 'month'), 1, 12)}, "
    f"{whole_sql(u_sql(_K, 'day'), 1, 28)})"
)
_DIGITS = " || ".join(
    f"CAST({whole_sql(u_sql(_K, p), a, b)} AS VARCHAR)"
    for p, a, b in (("area", 200, 999), ("prefix", 200, 999), ("line", 1000, 9999))
)
CONTACTS = f"""
WITH base AS (SELECT c_custkey AS contact_id, {_FIRST} AS first_name, {_LAST} AS last_name, {_DIGITS} AS digits,
  {_mail(_K)} AS email, {_DAY} AS born, CAST({whole_sql(u_sql(_K, 'zip'), 10000, 99999)} AS VARCHAR) AS zip FROM customer),
cased AS (SELECT *, CASE WHEN {hit('contact_id', 0.10, 'case email')} THEN upper(email) ELSE email END AS mail FROM base)
SELECT contact_id, first_name, last_name, {phone_sql('digits', u_sql('contact_id', 'layout phone'))} AS phone,
  CASE WHEN {hit('contact_id', 0.10, 'pad email')} THEN '  ' || mail || '  ' ELSE mail END AS email,
  {date_sql('born', u_sql('contact_id', 'layout birth_date'))} AS birth_date,
  zip || {pick_sql(u_sql('contact_id', 'suffix zip_code'), inject.ZIP_SUFFIXES)} AS zip_code,
  {pick_sql(u_sql('contact_id', 'spelling country'), inject.COUNTRY_SPELLINGS)} AS country FROM cased
"""


@query("gen_contacts", CONTACTS)
def _(spark, sf):
    return inject.gen_contacts(read(spark, sf, "customer"), "c_custkey")


_O = "o_orderkey"
ORDERS = f"""
WITH base AS (SELECT o_orderkey AS order_id, {whole_sql(u_sql(_O, 'customer'), 1, 1000)} AS customer_id,
  {pick_sql(u_sql(_O, 'product'), inject.PRODUCTS)} AS product, {whole_sql(u_sql(_O, 'price'), 1000, 50000)} / 100::DOUBLE AS price,
  {whole_sql(u_sql(_O, 'quantity'), 1, 19)} AS quantity,
  strftime(DATE '2023-01-01' + CAST({whole_sql(u_sql(_O, 'day'), 0, 364)} AS INT), '%Y-%m-%d') AS order_date FROM orders),
dirt AS (SELECT order_id,
  CASE WHEN {hit('order_id', 0.10, 'orphan customer_id')}
    THEN {whole_sql(u_sql('order_id', 'absent customer_id'), 1001, 1049)} ELSE customer_id END AS customer_id, product,
  round({outlier_sql('price', 'order_id', 'price', 0.05, 10, 50)}, 2) AS price,
  CAST(floor({outlier_sql('quantity', 'order_id', 'quantity', 0.05, 20, 50)}) AS BIGINT) AS quantity, order_date FROM base)
SELECT * FROM dirt UNION ALL SELECT * REPLACE (order_id + 1000000000000 AS order_id) FROM dirt
WHERE {hit('order_id', 0.08, 'near duplicate')}
"""


@query("gen_orders", ORDERS)
def _(spark, sf):
    return inject.gen_orders(read(spark, sf, "orders"), "o_orderkey", 1000)
