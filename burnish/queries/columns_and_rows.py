"""Sources, column operators and conditional row removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.operators.columns import cast_column, drop_column, rename_column, select_columns
from burnish.operators.missing import fill_missing
from burnish.operators.rows import drop_rows_by_condition, union_all
from burnish.operators.scratch import new_folder
from burnish.quality.regression import label_encode
from burnish.queries.dirty import contacts, date_sql, dirty, number_sql, orders, people, with_views
from burnish.queries.registry import query, read
from burnish.sources.tables import load_tables, preview_aux, write_clean

PEOPLE = ("id", "name", "age", "department", "salary", "email")


def _people(**changed: str) -> str:
    """A select list of people with some columns replaced."""
    return ", ".join(f"{changed[c]} AS {c}" if c in changed else c for c in PEOPLE)


@query(
    "load_tables",
    "SELECT o.o_orderstatus AS status, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1",
)
def _(spark, sf):
    loaded = load_tables(spark, {n: f"{sf}/{n}.parquet" for n in ("orders", "customer")})
    joined = loaded["orders"].join(loaded["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(
    "preview_aux",
    with_views(
        "SELECT *, (SELECT count(*) FROM dirty_customers) AS total_rows FROM dirty_customers ORDER BY customer_id LIMIT 3",
        "dirty_customers",
    ),
)
def _(spark, sf):
    return preview_aux(dirty(spark, sf, "dirty_customers"), ["customer_id"])


@query("write_clean", contacts("SELECT contact_id, upper(country) AS country, phone FROM dirty_contacts"))
def _(spark, sf):
    clean = dirty(spark, sf, "dirty_contacts").select("contact_id", F.upper("country").alias("country"), "phone")
    path = new_folder(spark)
    write_clean(clean, path, partition_by=["country"])
    return spark.read.parquet(path)


@query("rename_column", people("SELECT id, name, age, department, salary AS pay, email FROM dirty_people"))
def _(spark, sf):
    return rename_column(dirty(spark, sf, "dirty_people"), "salary", "pay")


@query("drop_column", people("SELECT id, name, age, department, salary FROM dirty_people"))
def _(spark, sf):
    return drop_column(dirty(spark, sf, "dirty_people"), "email")


@query("select_columns", with_views("SELECT customer_id, segment, country FROM dirty_customers", "dirty_customers"))
def _(spark, sf):
    return select_columns(dirty(spark, sf, "dirty_customers"), "customer_id", ["segment", "absent", "country"])


@query("cast_int", people(f"SELECT {_people(age='CAST(age AS BIGINT)')} FROM dirty_people"))
def _(spark, sf):
    return cast_column(dirty(spark, sf, "dirty_people"), "age", "int")


@query("cast_float", contacts(f"SELECT contact_id, {number_sql('zip_code')} AS zip_code FROM dirty_contacts"))
def _(spark, sf):
    return cast_column(dirty(spark, sf, "dirty_contacts").select("contact_id", "zip_code"), "zip_code", "float")


@query("cast_string", orders("SELECT order_id, CAST(quantity AS VARCHAR) AS quantity FROM dirty_orders"))
def _(spark, sf):
    return cast_column(dirty(spark, sf, "dirty_orders").select("order_id", "quantity"), "quantity", "string")


@query("cast_datetime", contacts(f"SELECT contact_id, {date_sql('birth_date')} AS birth_date FROM dirty_contacts"))
def _(spark, sf):
    return cast_column(dirty(spark, sf, "dirty_contacts").select("contact_id", "birth_date"), "birth_date", "datetime")


@query("cast_bool", "SELECT doc_id, quality <> 0 AS quality, toxic FROM labels")
def _(spark, sf):
    return cast_column(read(spark, sf, "labels"), "quality", "bool")


@query(
    "cast_category",
    orders(
        "SELECT order_id, product, CAST(code AS INT) AS code FROM dirty_orders JOIN codes USING (product)",
        more="codes AS (SELECT product, dense_rank() OVER (ORDER BY product) - 1 AS code FROM dirty_orders GROUP BY product)",
    ),
)
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders").select("order_id", "product")
    return label_encode(cast_column(df, "product", "category"), "product", "code")


def _dropping(name: str, view: str, wrap, column: str, operator: str, value: object, kept: str) -> None:
    @query(name, wrap(f"SELECT * FROM {view} WHERE {kept}"))
    def _(spark, sf):
        return drop_rows_by_condition(dirty(spark, sf, view), column, operator, value)


_dropping("drop_rows_eq", "dirty_orders", orders, "customer_id", "==", 42, "customer_id IS DISTINCT FROM 42")
_dropping("drop_rows_ne", "dirty_orders", orders, "product", "!=", "Phone", "product = 'Phone'")
_dropping("drop_rows_gt", "dirty_orders", orders, "customer_id", ">", 500, "customer_id IS NULL OR customer_id <= 500")
_dropping("drop_rows_lt", "dirty_people", people, "age", "<", 40, "age IS NULL OR age >= 40")
_dropping(
    "drop_rows_ge", "dirty_contacts", contacts, "zip_code", ">=", "50000",
    f"coalesce(NOT ({number_sql('zip_code')}) >= 50000, true)",
)
_dropping("drop_rows_le", "dirty_people", people, "age", "<=", 30, "age IS NULL OR age > 30")
_dropping("drop_rows_isnull", "dirty_orders", orders, "customer_id", "isnull", None, "customer_id IS NOT NULL")
_dropping("drop_rows_notnull", "dirty_people", people, "email", "notnull", None, "email IS NULL")
_dropping(
    "drop_rows_contains", "dirty_people", people, "email", "contains", r"^USER\d+5@",
    r"coalesce(NOT regexp_matches(email, '^USER\d+5@'), true)",
)


@query("fill_missing_drop", people("SELECT * FROM dirty_people WHERE age IS NOT NULL"))
def _(spark, sf):
    return fill_missing(dirty(spark, sf, "dirty_people"), "age", "drop")


@query(
    "union_all",
    with_views(
        "SELECT * FROM dirty_customers UNION ALL SELECT * FROM dirty_customers WHERE country = 'US'", "dirty_customers"
    ),
)
def _(spark, sf):
    df = dirty(spark, sf, "dirty_customers")
    return union_all(df, df.where("country = 'US'"))
