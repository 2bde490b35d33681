"""Merges and foreign keys."""

from __future__ import annotations

from burnish.operators.references import fix_referential_integrity, fk_violations, merge_tables
from burnish.queries.dirty import dirty, orders, tables, with_views
from burnish.queries.registry import query

ORDER = ("order_id", "product", "price", "quantity", "order_date")
_O = ", ".join(f"o.{c}" for c in ORDER)
_ON = "ON o.customer_id IS NOT DISTINCT FROM c.customer_id"


@query(
    "merge_left",
    orders(f"SELECT o.customer_id, {_O}, c.segment FROM dirty_orders o LEFT JOIN dirty_customers c {_ON}"),
)
def _(spark, sf):
    return merge_tables(
        dirty(spark, sf, "dirty_orders"), "customers", "customer_id", "customer_id", "left", ["segment"], tables(spark, sf)
    )


@query(
    "merge_inner",
    with_views(
        "SELECT p.*, c.customer_id, c.name AS name_customers, c.segment, c.country FROM dirty_people p "
        "JOIN dirty_customers c ON p.id = c.customer_id",
        "dirty_people", "dirty_customers",
    ),
)
def _(spark, sf):
    return merge_tables(
        dirty(spark, sf, "dirty_people"), "customers", "id", "customer_id", "inner", tables=tables(spark, sf)
    )


@query(
    "merge_right",
    orders(
        f"SELECT c.customer_id, {_O}, c.name, c.segment, c.country FROM dirty_orders o RIGHT JOIN dirty_customers c {_ON}"
    ),
)
def _(spark, sf):
    return merge_tables(
        dirty(spark, sf, "dirty_orders"), "customers", "customer_id", "customer_id", "right", tables=tables(spark, sf)
    )


@query(
    "merge_outer",
    orders(
        f"SELECT coalesce(o.customer_id, c.customer_id) AS customer_id, {_O}, c.segment, c.country "
        f"FROM dirty_orders o FULL JOIN dirty_customers c {_ON}"
    ),
)
def _(spark, sf):
    return merge_tables(
        dirty(spark, sf, "dirty_orders"), "customers", "customer_id", "customer_id", "outer", ["segment", "country"],
        tables(spark, sf),
    )


@query("fk_drop", orders("SELECT * FROM dirty_orders WHERE customer_id IN (SELECT customer_id FROM dirty_customers)"))
def _(spark, sf):
    return fix_referential_integrity(
        dirty(spark, sf, "dirty_orders"), "customer_id", "customers", "customer_id", "drop", tables(spark, sf)
    )


@query(
    "fk_flag",
    orders(
        "SELECT *, CAST(coalesce(customer_id IN (SELECT customer_id FROM dirty_customers), false) AS INT) "
        "AS customer_id_valid FROM dirty_orders"
    ),
)
def _(spark, sf):
    return fix_referential_integrity(
        dirty(spark, sf, "dirty_orders"), "customer_id", "customers", "customer_id", "flag", tables(spark, sf)
    )


@query(
    "fk_violations",
    orders(
        "SELECT * FROM dirty_orders o WHERE NOT EXISTS "
        "(SELECT 1 FROM dirty_customers c WHERE c.customer_id = o.customer_id)"
    ),
)
def _(spark, sf):
    return fk_violations(dirty(spark, sf, "dirty_orders"), "customer_id", "customers", "customer_id", tables(spark, sf))
