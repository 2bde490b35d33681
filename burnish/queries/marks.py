"""NaN as a mark of missing values, steps that must fail, and steps read from replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.operators.missing import fill_missing
from burnish.operators.ordered import ranked_values, sample_values
from burnish.operators.rows import drop_duplicates, drop_rows_by_condition
from burnish.operators.stats import duplicate_count, mode, null_counts, quantiles
from burnish.plans.responses import parse_actions, steps_from
from burnish.plans.runner import run_plan
from burnish.quality.profile import detect_missing
from burnish.queries.dirty import dirty, people, title_sql
from burnish.queries.registry import query, read

# The same rows for both engines, but for NaN, which SQL sees as null.
MARKED = (
    "marked AS (SELECT o_orderkey AS k, o_custkey % 100 AS g, "
    "CASE WHEN o_orderkey % 7 < 2 THEN NULL ELSE CAST(o_custkey % 50 AS DOUBLE) END AS x FROM orders)"
)


def marked(spark: SparkSession, sf: str) -> DataFrame:
    seven = F.col("o_orderkey") % 7
    x = F.when(seven == 0, F.lit(float("nan"))).when(seven > 1, (F.col("o_custkey") % 50).cast("double"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 100).alias("g"), x.alias("x"))


def last_known(direction: str) -> str:
    return f"last_value(x IGNORE NULLS) OVER (PARTITION BY g ORDER BY k {direction} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


for _name, _forward, _direction in (("nan_forward_fill", "forward_fill", "ASC"), ("nan_backward_fill", "backward_fill", "DESC")):

    @query(_name, f"WITH {MARKED} SELECT k, g, {last_known(_direction)} AS x FROM marked")
    def _(spark, sf, how=_forward):
        return fill_missing(marked(spark, sf), "x", how, order_by=["k"], partition_by=["g"])


@query("nan_drop_isnull", f"WITH {MARKED} SELECT k, g, x FROM marked WHERE x IS NOT NULL")
def _(spark, sf):
    return drop_rows_by_condition(marked(spark, sf), "x", "isnull")


@query("nan_drop_notnull", f"WITH {MARKED} SELECT k, g, x FROM marked WHERE x IS NULL")
def _(spark, sf):
    kept = drop_rows_by_condition(marked(spark, sf), "x", "notnull")
    return kept.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))


@query("nan_null_count", f"WITH {MARKED} SELECT 0::BIGINT AS k, 0::BIGINT AS g, count(*) - count(x) AS x, count(*) - count(x) AS total FROM marked")
def _(spark, sf):
    return null_counts(marked(spark, sf))


@query("nan_mode", f"WITH {MARKED} SELECT x AS value FROM marked WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 1")
def _(spark, sf):
    return spark.createDataFrame([(mode(marked(spark, sf), "x"),)], "value double")


@query("nan_duplicates", f"WITH {MARKED} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(n) AS BIGINT) AS total_rows "
       "FROM (SELECT count(*) AS n FROM marked GROUP BY g, x)")  # fmt: skip
def _(spark, sf):
    return duplicate_count(marked(spark, sf), ["g", "x"])


@query("nan_dedup_first", f"WITH {MARKED} SELECT min(k) AS k, g, x FROM marked GROUP BY g, x")
def _(spark, sf):
    kept = drop_duplicates(marked(spark, sf), ["g", "x"], "first", ["k"])
    return kept.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))


@query("nan_dedup_none", f"WITH {MARKED} SELECT min(k) AS k, g, x FROM marked GROUP BY g, x HAVING count(*) = 1")
def _(spark, sf):
    kept = drop_duplicates(marked(spark, sf), ["g", "x"], "none")
    return kept.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))


@query("nan_ranks", f"WITH {MARKED} SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM (SELECT DISTINCT x FROM marked WHERE x IS NOT NULL)")
def _(spark, sf):
    return ranked_values(marked(spark, sf), "x", "code")


@query("nan_sample", f"WITH {MARKED} SELECT list(CAST(x AS BIGINT) || '.0' ORDER BY k) AS sample_values "
       "FROM (SELECT * FROM marked WHERE x IS NOT NULL ORDER BY k LIMIT 5)")  # fmt: skip
def _(spark, sf):
    return sample_values(marked(spark, sf), ["k"]).where("column_name = 'x'").select("sample_values")


@query("nan_detect_missing", f"WITH {MARKED} SELECT 'missing_values' AS issue_type, 'x' AS \"column\", count(*) - count(x) AS affected_rows FROM marked")
def _(spark, sf):
    return detect_missing(marked(spark, sf)).select("issue_type", "column", "affected_rows")


SHARES = (0.0, 0.001, 0.25, 0.999, 1.0)


@query("agg_quantile_ends", " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS share, round(quantile_cont(l_extendedprice, {p}), 6) AS value FROM lineitem" for p in SHARES
))
def _(spark, sf):
    found = quantiles(read(spark, sf, "lineitem"), {"l_extendedprice": SHARES})[0]["l_extendedprice"]
    return spark.createDataFrame([(p, round(found[p], 6)) for p in SHARES], "share double, value double")


BAD_STEPS = [
    {"action_type": "normalize_format", "parameters": {"column": "email", "format_type": "date", "output_format": 5}},
    {"action_type": "clip_outliers", "parameters": {"column": "age", "bounds": [1]}},
    {"action_type": "drop_column", "parameters": ["age"]},
    {"action_type": "drop_column", "parameters": "age"},
    {"action_type": "apply_regex", "parameters": {"column": "email", "pattern": "(?(1)a|b)", "replacement": ""}},
    {"action_type": "apply_regex", "parameters": {"column": "email", "pattern": "(a)", "replacement": r"\2"}},
    {"action_type": "normalize_format", "parameters": {"column": "email", "format_type": "date", "layouts": ["bbbb"]}},
]


@query("run_plan_bad_steps", people("SELECT id, name, age, department, salary, email, 7 AS failed FROM dirty_people"))
def _(spark, sf):
    """The table as it was, with the number of steps that failed."""
    result = run_plan(dirty(spark, sf, "dirty_people"), BAD_STEPS)
    return result.df.withColumn("failed", F.lit(sum(not r.success for r in result.records)))


def reply_of(region: Column) -> Column:
    title = '{"action_type": "standardize_text", "parameters": {"column": "name", "operations": ["title"]}}'
    bounds = '```json\n{"action_type": "clip_outliers", "parameters": {"column": "age", "bounds": [30, 60]}}\n```'
    known = '{"action_type": "drop_rows_by_condition", "parameters": {"column": "age", "operator": "isnull"}}'
    return F.when(region == 0, title).when(region == 1, bounds).when(region == 2, known).otherwise("I have no further step.")


@query("plan_from_replies", people(f"SELECT id, {title_sql('name')} AS name, least(greatest(age, 30), 60) AS age FROM dirty_people WHERE age IS NOT NULL"))
def _(spark, sf):
    """A plan whose steps stand in the replies of a table, one per region, run over the people."""
    replies = read(spark, sf, "region").select("r_regionkey", reply_of(F.col("r_regionkey")).alias("reply"))
    steps = steps_from(parse_actions(replies, "reply"), ["r_regionkey"])
    return run_plan(dirty(spark, sf, "dirty_people"), steps).df.select("id", "name", "age")
