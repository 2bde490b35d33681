"""Types from values, dates read as their column is, dictionaries that only grow, and streams with a memory."""

from __future__ import annotations

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from burnish.errors import CleaningError
from burnish.functions.draws import draw
from burnish.functions.formats import DATE_LAYOUTS, _instant, voted_layouts
from burnish.operators.dictionaries import append_dictionary, decode, encode, extend_dictionary, load_dictionary
from burnish.operators.formats import normalize_format
from burnish.operators.inject import inject_nulls
from burnish.operators.joining import JoinLimits
from burnish.operators.stats import DATE_VOTES, Need
from burnish.plans.recipes import step
from burnish.plans.runner import run_plan
from burnish.quality.types import detect_value_types, merge_masks, type_masks, type_steps, value_types
from burnish.streaming.batches import BATCH, distinct_within, write_batches
from burnish.streaming.clean import clean_stream, freeze_steps

# --- types ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("values", "held"),
    [
        (["1", " 2 ", None], "int"), (["1", "2.5"], "float"), (["1e3", "-7."], "int"), (["$1,200.00", "3"], "money"),
        (["2021-03-04", "Mar 4, 2021"], "datetime"), (["yes", " NO"], "bool"), (["yes", "1"], "text"), (["", "1"], "text"),
        ([None, None], None), ([], None), (["9007199254740993000"], "float"), (["nan"], "text"), (["12:30"], "text"),
    ],
)
def test_type_of_text(spark, values, held):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    row = detect_value_types(df).first()
    assert (row.value_type, row["values"], row.stored_type) == (held, sum(v is not None for v in values), "string")


def test_types_of_other_columns(spark):
    df = spark.sql(
        "SELECT 1 AS i, CAST(2 AS DOUBLE) AS w, CAST('NaN' AS DOUBLE) AS n, 2.5D AS f, CAST(3 AS DECIMAL(9,2)) AS d, "
        "DATE'2021-01-01' AS day, TIMESTAMP'2021-01-01 00:00:00' AS t, true AS b, array(1) AS a, CAST(NULL AS INT) AS z"
    )
    got = {r.column_name: r.value_type for r in detect_value_types(df).collect()}
    assert got == {
        "i": "int", "w": "int", "n": None, "f": "float", "d": "int", "day": "datetime", "t": "datetime", "b": "bool",
        "a": "text", "z": None,
    }
    with pytest.raises(CleaningError):
        detect_value_types(df, ["no"])


def test_masks_of_parts_merge(spark):
    df = spark.range(300).select(
        F.when(F.col("id") == 299, "2.5").otherwise(F.col("id").cast("string")).alias("x"),
        F.when(F.col("id") > 200, F.lit("word")).alias("y"),
    )
    parts = [type_masks(df.where(F.expr(f"CASE WHEN x = '2.5' THEN 2 ELSE CAST(x AS INT) % 3 END = {i}"))) for i in range(3)]
    assert sorted(map(tuple, merge_masks(*parts).select("column_name", "values", "type_mask").collect())) == sorted(
        map(tuple, type_masks(df).select("column_name", "values", "type_mask").collect())
    )
    assert {r.column_name: r.value_type for r in value_types(merge_masks(*parts)).collect()} == {"x": "float", "y": "text"}


def test_one_pass_over_the_rows(spark):
    plan = type_masks(spark.range(10).select(F.col("id").cast("string").alias("x")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan


def test_steps_from_types(spark):
    df = spark.createDataFrame([("1", "$2", "yes", 3.0, "a"), (None, "$1,000.50", "no", 4.0, "1")], "i string, m string, b string, w double, t string")
    got = run_plan(df, type_steps(detect_value_types(df))).df
    assert got.dtypes == [("i", "bigint"), ("m", "double"), ("b", "boolean"), ("w", "bigint"), ("t", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 2.0, True, 3, "a"), (None, 1000.5, False, 4, "1")]
    assert type_steps(detect_value_types(got)) == []


# --- dates ----------------------------------------------------------------------------------------------------


def days(spark, values, **more):
    df = spark.createDataFrame(list(enumerate(values)), "i int, d string")
    return [r.d for r in normalize_format(df, "d", "date", **more).orderBy("i").collect()]


def test_column_decides_on_the_order(spark):
    slashes = ["3/4/2021", "13/4/2021", " 25/12/2020 ", "1/13/2021", None, "x"]
    assert days(spark, slashes) == ["2021-03-04", None, None, "2021-01-13", None, None]
    # Two votes against one; what only the other order can read is still read.
    assert days(spark, slashes, by_column=True) == ["2021-04-03", "2021-04-13", "2020-12-25", "2021-01-13", None, None]
    dashes = ["3-4-2021", "4-13-2021", "2021-05-06"]
    assert days(spark, dashes) == ["2021-04-03", None, "2021-05-06"]
    assert days(spark, dashes, by_column=True) == ["2021-03-04", "2021-04-13", "2021-05-06"]


@pytest.mark.parametrize("values", [["3/4/2021", "5/6/2021"], ["13/4/2021", "4/13/2021", "3/4/2021"], [], [None]])
def test_without_a_majority_nothing_changes(spark, values):
    got, want = days(spark, values, by_column=True), days(spark, values)
    assert [a for a, b in zip(got, want) if b] == [b for b in want if b]


def test_only_text_of_the_shape_is_tried(spark):
    """Reading with the shape of a layout checked first gives what Spark reads without."""
    layouts = [*DATE_LAYOUTS, "yyyyMMdd", "dd.MM.yy", "yyyy[-MM]", "D/yyyy", "h:mm a d-M-yyyy", "yyyy'a''b'MM", "MMMM d yyyy"]
    texts = [
        "2021-03-04", "+2021-03-04", "3/4/2021", "3/4/21", "4-3-2021", "Mar 4, 2021", "mar 4, 2021", "March 4, 2021", "Mar. 4, 2021",
        "2021-03-04 05:06:07", "2021-03-04T05:06:07", "2021-03-04t05:06:07", "20210304", "04.03.21", "2021", "2021-03",
        "60/2021", "5:06 pm 4-3-2021", "2021a'b03", "March 4 2021", "", " ", "x", "1" * 5000, "1" * 5000 + "-", "2021-13-04", "٢٠٢١-٠٣-٠٤", "2021-03-04\n",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    plain = [F.try_to_timestamp(F.concat(F.col("x"), F.lit(" Z")), F.lit(f"{layout} X")).alias(f"p{i}") for i, layout in enumerate(layouts)]
    shaped = [_instant(F.col("x"), layout).alias(f"s{i}") for i, layout in enumerate(layouts)]
    rows = df.select("x", *plain, *shaped).collect()
    assert [(r.x, layout) for r in rows for i, layout in enumerate(layouts) if r[f"p{i}"] != r[f"s{i}"]] == []
    assert sum(r[f"p{i}"] is not None for r in rows for i in range(len(layouts))) >= 12


def test_layouts_by_votes():
    assert voted_layouts([(0, 0), (0, 0)]) == [
        "yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "M-d-yyyy", *DATE_LAYOUTS[3:],
    ]
    assert voted_layouts([(2, 1), (0, 1)])[1:5] == ["d/M/yyyy", "M/d/yyyy", "M-d-yyyy", "d-M-yyyy"]
    assert voted_layouts([(1, 0), (0, 0)], ["yyyy"]) == ["yyyy", "d/M/yyyy", "M/d/yyyy", "M-d-yyyy", "d-M-yyyy"]


def test_votes_are_a_statistic_of_the_plan(spark):
    df = spark.createDataFrame([("13/4/2021",), ("3/4/2021",)], "d string")
    steps = [step("normalize_format", column="d", format_type="date", by_column=True)]
    frozen = freeze_steps(df, steps)
    assert list(frozen[0]) == [Need("d", DATE_VOTES)]
    later = spark.createDataFrame([("5/6/2021",)], "d string")
    assert clean_stream(later, steps, stats=frozen).first().d == "2021-06-05"
    assert run_plan(later, steps).df.first().d == "2021-05-06"
    with pytest.raises(CleaningError):
        clean_stream(later, steps)


def test_times_need_no_votes(spark):
    df = spark.createDataFrame([(datetime.date(2021, 3, 4),)], "d date")
    result = run_plan(df, [step("normalize_format", column="d", format_type="date", by_column=True)])
    assert result.df.first().d == "2021-03-04" and result.used == [{}]


# --- dictionaries ---------------------------------------------------------------------------------------------


def labels(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_codes_stay(spark, tmp_path):
    path = str(tmp_path / "codes")
    assert load_dictionary(spark, path) is None
    first = append_dictionary(labels(spark, "m", "c", None, "c"), "x", path)
    old = pairs(first)
    assert old == [("c", 0), ("m", 1)]
    second = append_dictionary(labels(spark, "z", "a", "m", None), "x", path)
    assert pairs(second) == [("a", 2), ("c", 0), ("m", 1), ("z", 3)]
    # Nothing new, and no rows at all.
    assert pairs(append_dictionary(labels(spark, "m"), "x", path)) == pairs(append_dictionary(labels(spark), "x", path)) == pairs(second)


@pytest.mark.parametrize("limits", [JoinLimits(), JoinLimits(broadcast_bytes=0, hot_rows=3)])
def test_encode_and_decode(spark, limits):
    df = labels(spark, *["hot"] * 9, "b", None, "new", "")
    codes = extend_dictionary(labels(spark, "b", "hot", ""), "x")
    coded = encode(df, "x", codes, "code", limits=limits)
    assert {(r.x, r.code) for r in coded.collect()} == {("hot", 2), ("b", 1), (None, None), ("new", None), ("", 0)}
    assert coded.count() == df.count()
    again = decode(coded, "code", codes, "y", limits)
    assert {(r.x, r.y) for r in again.collect()} == {("hot", "hot"), ("b", "b"), (None, None), ("new", None), ("", "")}
    with pytest.raises(PySparkException, match="no code for a label"):
        encode(df, "x", codes, "code", "fail", limits).collect()
    with pytest.raises(CleaningError):
        encode(df, "x", codes, "i")


def test_numbers_as_labels(spark):
    codes = extend_dictionary(spark.range(3), "id")
    assert pairs(encode(spark.range(3), "id", codes)) == [(0, 0), (1, 1), (2, 2)]


# --- streams --------------------------------------------------------------------------------------------------


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_memory_of_all_micro_batches(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "i int, k string, x double"
    start = lambda: run(write_batches(spark.readStream.schema(schema).parquet(source), out, state, distinct=["k", "x"], order_by=["i"]))
    put(spark, [(1, "a", 1.0), (2, "a", 1.0), (3, None, None)], schema, source)
    start()
    put(spark, [(4, "a", 1.0), (5, None, float("nan")), (6, "b", 1.0), (7, "b", 1.0), (8, "a", 2.0)], schema, source)
    start()
    got = spark.read.parquet(out)
    assert sorted((r.i, r[BATCH]) for r in got.collect()) == [(1, 0), (3, 0), (6, 1), (8, 1)]


def test_repeated_micro_batch_replaces_itself(spark, tmp_path):
    """A new checkpoint numbers micro-batches from zero again, as a repeated one has the number it had."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, [(1, "a"), (2, "b")], "i int, k string", source)
    for state in ("one", "two"):
        stream = spark.readStream.schema("i int, k string").parquet(source)
        run(write_batches(stream, out, str(tmp_path / state), distinct=["k"], order_by=["i"]))
    assert sorted(r.i for r in spark.read.parquet(out).collect()) == [1, 2]


def test_parents_are_read_anew(spark, tmp_path):
    source, out, state, parents = (str(tmp_path / n) for n in ("in", "out", "state", "parents"))
    steps = [step("fix_referential_integrity", child_column="k", parent_table="p", parent_column="k", action="drop")]
    start = lambda: run(write_batches(
        spark.readStream.schema("k int").parquet(source), out, state, steps, lambda s: {"p": s.read.parquet(parents)},
    ))
    put(spark, [(1,)], "k int", parents)
    put(spark, [(1,), (2,)], "k int", source)
    start()
    put(spark, [(2,)], "k int", parents)
    put(spark, [(1,), (2,), (3,)], "k int", source)
    start()
    assert sorted((r.k, r[BATCH]) for r in spark.read.parquet(out).collect()) == [(1, 0), (1, 1), (2, 1)]


def test_failed_step_ends_the_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, [(1,)], "k int", source)
    stream = spark.readStream.schema("k int").parquet(source)
    writer = write_batches(stream, str(tmp_path / "out"), str(tmp_path / "state"), [step("drop_column", column="no")])
    with pytest.raises(PySparkException):
        run(writer)
    with pytest.raises(CleaningError):
        write_batches(stream, str(tmp_path / "out"), str(tmp_path / "state"), distinct=["k"])


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_late_rows(spark, tmp_path, kind):
    """A repeat within the delay is dropped; one that the watermark has left behind is too late for any state."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    schema = f"k string, t {kind}"

    def start():
        kept = distinct_within(spark.readStream.schema(schema).parquet(source), ["k"], "t", "10 minutes")
        run(kept.writeStream.format("parquet").option("checkpointLocation", state).option("path", out))

    for rows in ([("a", at(0)), ("a", at(5))], [("a", at(8)), ("b", at(40))], [("a", at(45)), ("late", at(1))]):
        put(spark, rows, schema, source)
        start()
    got = sorted((r.k, r.t.minute) for r in spark.read.schema(schema).parquet(out).collect())
    assert [k for k, _ in got] == ["a", "a", "b"] and got[1:] == [("a", 45), ("b", 40)]
    with pytest.raises(CleaningError):
        distinct_within(spark.readStream.schema(schema).parquet(source), [], "t", "1 hour")


# --- draws ----------------------------------------------------------------------------------------------------


def test_null_keys_draw_too(spark):
    df = spark.createDataFrame([(None, "x")], "k int, v string")
    assert 0 <= df.select(draw(F.col("k"), 1, "p").alias("u")).first().u < 1
    assert inject_nulls(df, "v", 0.0, "k").first().v == "x" and inject_nulls(df, "v", 1.0, "k").first().v is None
