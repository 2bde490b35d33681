"""Column statistics, duplicates, and operators that follow an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from burnish.operators.inject import shuffle_rows
from burnish.operators.missing import fill_missing
from burnish.operators.ordered import head_rows, ranked_values, sample_values
from burnish.operators.rows import drop_duplicates
from burnish.operators.stats import (
    MEDIAN,
    QUARTILES,
    Need,
    distinct_counts,
    duplicate_count,
    fraction,
    measure,
    mode,
    null_counts,
    summary,
)
from burnish.plans.recipes import ORDER_CONTENT
from burnish.quality.profile import detect_issues, top_issues
from burnish.queries.dirty import dirty, money_sql, orders, people, with_views
from burnish.queries.registry import query, read

CONTENT = ", ".join(ORDER_CONTENT)


@query(
    "agg_mean",
    orders("SELECT round(avg(price), 4) AS price_mean, round(avg(quantity), 4) AS quantity_mean FROM dirty_orders"),
)
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders")
    return df.agg(*[F.round(summary(df, c)["mean"], 4).alias(f"{c}_mean") for c in ("price", "quantity")])


@query(
    "agg_std",
    orders(
        "SELECT round(stddev_samp(price), 4) AS price_std, round(stddev_samp(quantity), 4) AS quantity_std FROM dirty_orders"
    ),
)
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders")
    return df.agg(*[F.round(summary(df, c)["std"], 4).alias(f"{c}_std") for c in ("price", "quantity")])


@query(
    "agg_minmax",
    orders(
        "SELECT min(price) AS price_min, max(price) AS price_max, CAST(min(quantity) AS DOUBLE) AS quantity_min, "
        "CAST(max(quantity) AS DOUBLE) AS quantity_max FROM dirty_orders"
    ),
)
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders")
    return df.agg(*[summary(df, c)[s].alias(f"{c}_{s}") for c in ("price", "quantity") for s in ("min", "max")])


@query(
    "agg_median",
    with_views(
        f"SELECT 'age' AS measure, quantile_cont(age, 0.5) AS median FROM dirty_people UNION ALL "
        f"SELECT 'salary', quantile_cont({money_sql('salary')}, 0.5) FROM dirty_people",
        "dirty_people",
    ),
)
def _(spark, sf):
    df = dirty(spark, sf, "dirty_people").withColumn("salary", F.regexp_replace("salary", "[$,]", ""))
    found = measure(df, [Need("age", MEDIAN), Need("salary", MEDIAN)])
    return spark.createDataFrame([(n.column, v) for n, v in found.items()], "measure string, median double")


@query(
    "agg_mode",
    orders(
        "SELECT 'product' AS measure, (SELECT product FROM dirty_orders GROUP BY product "
        "ORDER BY count(*) DESC, product LIMIT 1) AS mode UNION ALL "
        "SELECT 'quantity', (SELECT CAST(quantity AS VARCHAR) FROM dirty_orders GROUP BY quantity "
        "ORDER BY count(*) DESC, quantity LIMIT 1)"
    ),
)
def _(spark, sf):
    df = dirty(spark, sf, "dirty_orders")
    return spark.createDataFrame(
        [(c, str(mode(df, c))) for c in ("product", "quantity")], "measure string, mode string"
    )


@query(
    "agg_quantiles",
    "SELECT 'price' AS measure, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, "
    "round(quantile_cont(o_totalprice, 0.75), 6) AS q3 FROM orders",
)
def _(spark, sf):
    need = Need("o_totalprice", QUARTILES)
    low, high = measure(read(spark, sf, "orders"), [need])[need]
    return spark.createDataFrame([("price", round(low, 6), round(high, 6))], "measure string, q1 double, q3 double")


@query(
    "agg_null_count",
    people(
        "SELECT count(*) - count(id) AS id, count(*) - count(name) AS name, count(*) - count(age) AS age, "
        "count(*) - count(department) AS department, count(*) - count(salary) AS salary, count(*) - count(email) AS email, "
        "3 * count(*) - count(age) - count(salary) - count(email) AS total FROM dirty_people"
    ),
)
def _(spark, sf):
    return null_counts(dirty(spark, sf, "dirty_people"))


@query(
    "agg_nunique",
    people(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count FROM dirty_people"
            for c in ("id", "name", "age", "department", "salary", "email")
        )
    ),
)
def _(spark, sf):
    return distinct_counts(dirty(spark, sf, "dirty_people"))


@query(
    "agg_dup_count",
    orders(
        f"SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(n) AS BIGINT) AS total_rows "
        f"FROM (SELECT count(*) AS n FROM dirty_orders GROUP BY {CONTENT})"
    ),
)
def _(spark, sf):
    return duplicate_count(dirty(spark, sf, "dirty_orders"), ORDER_CONTENT)


@query(
    "agg_fraction",
    people(
        "SELECT round(avg(CASE WHEN email = lower(email) THEN 1.0 ELSE 0.0 END), 6) AS lower_of_all, "
        "round(count(*) FILTER (email = lower(email)) / CAST(count(email) AS DOUBLE), 6) AS lower_of_known FROM dirty_people"
    ),
)
def _(spark, sf):
    email = F.col("email")
    lower = email == F.lower(email)
    return dirty(spark, sf, "dirty_people").agg(
        F.round(fraction(lower), 6).alias("lower_of_all"),
        F.round(fraction(lower, email.isNotNull()), 6).alias("lower_of_known"),
    )


@query(
    "fill_missing_ffill",
    with_views(
        "SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM gaps",
        "gaps",
    ),
)
def _(spark, sf):
    return fill_missing(dirty(spark, sf, "gaps"), "value", "forward_fill", order_by=["event_id"])


@query(
    "fill_missing_bfill",
    with_views(
        "SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id "
        "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM gaps",
        "gaps",
    ),
)
def _(spark, sf):
    return fill_missing(
        dirty(spark, sf, "gaps"), "value", "backward_fill", order_by=["event_id"], partition_by=["user_id"]
    )


def _deduplicated(name: str, keep: str, kept: str) -> None:
    windows = (
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY {CONTENT} ORDER BY order_id) AS up, "
        f"row_number() OVER (PARTITION BY {CONTENT} ORDER BY order_id DESC) AS down FROM dirty_orders)"
    )

    @query(name, orders(f"SELECT order_id, {CONTENT} FROM ranked WHERE {kept}", more=windows))
    def _(spark, sf):
        return drop_duplicates(dirty(spark, sf, "dirty_orders"), ORDER_CONTENT, keep, ["order_id"])


_deduplicated("dedup_keep_first", "first", "up = 1")
_deduplicated("dedup_keep_last", "last", "down = 1")
_deduplicated("dedup_keep_none", "none", "up = 1 AND down = 1")


LINE = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


@query(
    "dedup_lineitem",
    "SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    f"ORDER BY {', '.join(LINE[2:])}) AS place FROM lineitem) WHERE place = 1",
)
def _(spark, sf):
    return drop_duplicates(read(spark, sf, "lineitem"), LINE[:2], "first", LINE[2:])


@query(
    "dedup_documents",
    "SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS place "
    "FROM documents) WHERE place = 1",
)
def _(spark, sf):
    return drop_duplicates(read(spark, sf, "documents"), ["text"], "last", ["doc_id"])


@query("dedup_rows", people("SELECT DISTINCT * FROM dirty_people"))
def _(spark, sf):
    return drop_duplicates(dirty(spark, sf, "dirty_people"))


@query(
    "label_encode_rank",
    with_views(
        "SELECT segment, CAST(row_number() OVER (ORDER BY segment) - 1 AS INT) AS code "
        "FROM dirty_customers GROUP BY segment",
        "dirty_customers",
    ),
)
def _(spark, sf):
    return ranked_values(dirty(spark, sf, "dirty_customers"), "segment", "code")


@query(
    "sample_values",
    people(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, (SELECT string_agg(v, '|') FROM (SELECT CAST({c} AS VARCHAR) AS v "
            f"FROM dirty_people WHERE {c} IS NOT NULL ORDER BY id LIMIT 5)) AS sample_values"
            for c in ("id", "name", "age", "department", "salary", "email")
        )
    ),
)
def _(spark, sf):
    found = sample_values(dirty(spark, sf, "dirty_people"), ["id"])
    return found.withColumn("sample_values", F.array_join("sample_values", "|"))


@query("head_rows", orders("SELECT * FROM dirty_orders ORDER BY order_id LIMIT 3"))
def _(spark, sf):
    return head_rows(dirty(spark, sf, "dirty_orders"), ["order_id"])


@query("shuffle_rows", orders("SELECT * FROM dirty_orders"))
def _(spark, sf):
    return shuffle_rows(dirty(spark, sf, "dirty_orders"), "order_id")


@query("top_issues")
def _(spark, sf):
    return top_issues(detect_issues(dirty(spark, sf, "dirty_people")))
