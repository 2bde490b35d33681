"""What is learnt from values and stays right as tables grow: types, orders of dates, dictionaries, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.operators.dictionaries import decode, encode, extend_dictionary
from burnish.operators.formats import normalize_format
from burnish.operators.scratch import new_folder, settle
from burnish.plans.recipes import step
from burnish.plans.runner import run_plan
from burnish.quality.sketches import column_sketches, merge_sketches, profile_of
from burnish.quality.types import TRUTH_WORDS, detect_value_types, merge_masks, type_masks, type_steps, value_types
from burnish.queries.dirty import date_sql, dirty, money_sql, number_sql, people, strip_sql, with_views
from burnish.queries.registry import query, read
from burnish.streaming.batches import BATCH, distinct_within, write_batches

# --- types ----------------------------------------------------------------------------------------------------


def type_sql(view: str, column: str, stored: str) -> str:
    """The row of one column in SQL: the first type that all its values can be read as."""
    if stored == "string":
        words = ", ".join(f"'{w}'" for w in TRUTH_WORDS)
        tests = {
            "int": f"coalesce({number_sql(column)} % 1 = 0, false)", "float": f"{number_sql(column)} IS NOT NULL",
            "money": f"{money_sql(column)} IS NOT NULL", "datetime": f"{date_sql(column)} IS NOT NULL",
            "bool": f"lower({strip_sql(column)}) IN ({words})",
        }
    else:
        tests = {"int": f"{column} % 1 = 0", "float": "true"}
    whens = " ".join(f"WHEN bool_and({test}) FILTER ({column} IS NOT NULL) THEN '{name}'" for name, test in tests.items())
    held = f"CASE WHEN count({column}) = 0 THEN NULL {whens} ELSE 'text' END"
    return f"SELECT '{column}' AS column_name, '{stored}' AS stored_type, count({column}) AS \"values\", {held} AS value_type FROM {view}"


PEOPLE_TYPES = {"id": "bigint", "name": "string", "age": "double", "department": "string", "salary": "string", "email": "string"}
TEXT_TYPES = {
    "k": "bigint", "customer": "string", "half": "string", "regular": "string", "day": "string", "due": "string",
    "note": "string", "points": "double", "nothing": "string",
}
_TEXT_SQL = with_views(" UNION ALL ".join(type_sql("stored_as_text", c, t) for c, t in TEXT_TYPES.items()), "stored_as_text")


@query("value_types_people", people(" UNION ALL ".join(type_sql("dirty_people", c, t) for c, t in PEOPLE_TYPES.items())))
def _(spark, sf):
    return detect_value_types(dirty(spark, sf, "dirty_people"))


@query("value_types_merged", _TEXT_SQL)
def _(spark, sf):
    """The types of a table from the masks of its parts."""
    df = dirty(spark, sf, "stored_as_text")
    return value_types(merge_masks(*[type_masks(df.where(F.col("k") % 3 == i)) for i in range(3)]))


@query("plan_from_value_types", with_views(
    "SELECT k, CAST(trim(customer) AS BIGINT) AS customer, CAST(half AS DOUBLE) AS half, regular = 'Yes' AS regular, "
    "CAST(day AS TIMESTAMP) AS day, CAST(due[2:] AS DOUBLE) AS due, note, CAST(points AS BIGINT) AS points, nothing "
    "FROM stored_as_text", "stored_as_text",
))
def _(spark, sf):
    """Every column in the type that its values have."""
    df = dirty(spark, sf, "stored_as_text")
    return run_plan(df, type_steps(detect_value_types(df))).df


# --- dates ----------------------------------------------------------------------------------------------------

_TRUE_DAYS = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"


@query("normalize_date_by_column", _TRUE_DAYS)
def _(spark, sf):
    """The days there were, although most of the dates can be read in two orders."""
    return normalize_format(dirty(spark, sf, "split_dates"), "day", "date", by_column=True)


@query("plan_date_by_column", _TRUE_DAYS.replace("SELECT", "SELECT 1 AS done,", 1))
def _(spark, sf):
    """The same as a step of a plan, which takes the votes with the other statistics."""
    steps = [step("normalize_format", column="day", format_type="date", by_column=True)]
    result = run_plan(dirty(spark, sf, "split_dates"), steps)
    return result.df.withColumn("done", F.lit(sum(r.success for r in result.records)))


# --- dictionaries ---------------------------------------------------------------------------------------------

# Codes of customers as labels: those of early orders first, then those that later orders bring.
_CODES = (
    "WITH labels AS (SELECT CAST(o_custkey AS VARCHAR) AS label, min(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END) AS late "
    "FROM orders GROUP BY 1), codes AS (SELECT label, row_number() OVER (ORDER BY late, label) - 1 AS code FROM labels) "
)


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    return settle(extend_dictionary(orders, "o_custkey", settle(extend_dictionary(orders.where("o_orderkey % 5 = 0"), "o_custkey"))))


@query("dictionary_extended", f"{_CODES} SELECT label, code FROM codes")
def _(spark, sf):
    return dictionary(spark, sf)


@query("dictionary_encoded", f"{_CODES} SELECT o_orderkey, code, label AS again FROM orders JOIN codes ON label = CAST(o_custkey AS VARCHAR)")
def _(spark, sf):
    """Labels as codes, and codes as labels again."""
    orders, codes = read(spark, sf, "orders").select("o_orderkey", "o_custkey"), dictionary(spark, sf)
    return decode(encode(orders, "o_custkey", codes, "code", "fail"), "code", codes, "again").drop("o_custkey")


# --- streams --------------------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream; a stream reads folders or patterns, not a file."""
    schema = read(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


@query("stream_first_events", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def _(spark, sf):
    """The first event of each user and type, whichever micro-batch brings it."""
    path, key = new_folder(spark), ["user_id", "event_type"]
    events = event_stream(spark, sf).select("event_id", *key)
    writer = write_batches(events, path, new_folder(spark), distinct=key, order_by=["event_id"])
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(path).drop(BATCH)


@query("stream_references", "SELECT event_id, user_id, CAST(user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) AS INT) AS user_id_valid FROM events")
def _(spark, sf):
    """Events with a mark of whether their user is among the parents that are read anew for each micro-batch."""
    path = new_folder(spark)
    events = event_stream(spark, sf).select("event_id", "user_id")
    parents = lambda session: {"users": read(session, sf, "customer").where("c_custkey % 3 <> 0")}
    steps = [step("fix_referential_integrity", child_column="user_id", parent_table="users", parent_column="c_custkey", action="flag")]
    writer = write_batches(events, path, new_folder(spark), steps, parents)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).drop(BATCH)


@query("stream_distinct_within", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    """The keys of the events, each kept as state for as long as the watermark asks."""
    path = new_folder(spark)
    kept = distinct_within(event_stream(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "4000 days")
    writer = kept.writeStream.format("parquet").option("checkpointLocation", new_folder(spark)).option("path", path)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(path).select("user_id", "event_type")


# --- sketches -------------------------------------------------------------------------------------------------

_FEW = ("l_linenumber", "l_quantity", "l_discount", "l_returnflag")


def _sketch_sql(column: str) -> str:
    number = "NULL::DOUBLE" if column == "l_returnflag" else f"{column}::DOUBLE"
    return (
        f"SELECT '{column}' AS column_name, count({column}) AS \"values\", count(*) - count({column}) AS nulls, "
        f"min({number}) AS low, max({number}) AS high, count(DISTINCT {column}) AS distinct_values, "
        f"(SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {column})) AS most FROM lineitem"
    )


@query("sketches_merged", " UNION ALL ".join(map(_sketch_sql, _FEW)))
def _(spark, sf):
    """The profile of columns with few values, for which sketches are exact, from the sketches of eight parts."""
    lines = read(spark, sf, "lineitem").withColumn("part", F.col("l_orderkey") % 8)
    parts = settle(column_sketches(lines, _FEW, ["part"]))
    found = profile_of(merge_sketches(parts), most_frequent=1)
    most = F.col("most_frequent")[0]["count"].alias("most")
    return found.select("column_name", "values", "nulls", "low", "high", "distinct_values", most)


@query("sketches_within_error", "SELECT 'l_extendedprice' AS column_name, true AS distinct_close, true AS ranks_close")
def _(spark, sf):
    """Whether distinct values and quantiles of a column with many values are within the stated error."""
    lines, shares = read(spark, sf, "lineitem"), (0.1, 0.5, 0.9)
    found = profile_of(merge_sketches(column_sketches(lines.withColumn("part", F.col("l_orderkey") % 8), ["l_extendedprice"], ["part"])), shares)
    sketched, price = found.first(), F.col("l_extendedprice")
    off = [F.abs(F.count_if(price <= q) / F.count("*") - share) for q, share in zip(sketched["quantiles"], shares)]
    return lines.agg(
        F.first(F.lit(sketched["column_name"])).alias("column_name"),
        (F.abs(sketched["distinct_values"] / F.count_distinct(price) - 1) < 0.065).alias("distinct_close"),
        (F.greatest(*off) < 0.02).alias("ranks_close"),
    )
