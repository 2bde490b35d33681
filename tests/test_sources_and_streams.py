"""Reading, writing, streaming and injecting."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from burnish.errors import CleaningError
from burnish.operators import inject
from burnish.operators.scratch import new_folder, shared_folder
from burnish.operators.stats import MEDIAN, QUARTILES, Need
from burnish.plans.recipes import CONTACTS, step
from burnish.plans.runner import run_plan
from burnish.sources.tables import load_tables, preview_aux, write_clean
from burnish.streaming.clean import clean_stream, freeze_stats, freeze_steps


# --- sources --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 1.5, "a"), (2, float("nan"), None)], "k int, x double, s string")
    path = str(tmp_path / kind)
    write_clean(df, path, format=kind)
    schemas = {"t": df.schema} if kind in ("csv", "json") else None
    got = load_tables(spark, {"t": path}, kind, schemas)["t"]
    assert sorted(map(tuple, got.collect())) == [(1, 1.5, "a"), (2, None, None)]


def test_sources_refuse(spark, tmp_path):
    df = spark.range(1)
    for bad in (
        lambda: load_tables(spark, {"t": str(tmp_path)}, "xml"), lambda: load_tables(spark, {"t": str(tmp_path)}, "csv"),
        lambda: write_clean(df, str(tmp_path / "x"), mode="perhaps"),
    ):
        with pytest.raises(CleaningError):
            bad()


def test_partitioned_sink_and_modes(spark, tmp_path):
    df = spark.range(6).withColumn("part", F.col("id") % 2)
    path = str(tmp_path / "t")
    write_clean(df, path, partition_by=["part"])
    write_clean(df, path, "append", ["part"])
    assert spark.read.parquet(path).where("part = 1").count() == 6
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_clean(df, path)


def test_preview(spark):
    rows = preview_aux(spark.range(10).orderBy(F.desc("id")), ["id"]).collect()
    assert [tuple(r) for r in rows] == [(0, 10), (1, 10), (2, 10)]


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark) != new_folder(spark)


class Session:
    """A session with some settings, and perhaps a checkpoint folder set by its context."""

    def __init__(self, folder=None, **settings):
        self.conf = settings
        context = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: folder is not None, get=lambda: folder))
        self.sparkContext = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: context))


def test_scratch_goes_where_all_can_reach_it():
    settings = {"spark.sql.warehouse.dir": "s3:/w/"}
    assert shared_folder(Session(**settings, **{"spark.checkpoint.dir": "hdfs:/x"})) == "hdfs:/x"
    assert shared_folder(Session("hdfs:/set", **settings)) == "hdfs:/set"
    assert shared_folder(Session(**settings)) == "s3:/w/burnish-scratch"


# --- streams --------------------------------------------------------------------------------------------------


@pytest.fixture()
def contacts(spark, tmp_path):
    df = inject.gen_contacts(spark.range(1, 200), "id").withColumn("amount", F.col("contact_id").cast("double"))
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def drain(spark, stream, tmp_path):
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, contacts, tmp_path):
    static, stream = contacts
    tables = {"p": spark.range(0, 100).withColumnRenamed("id", "pid").withColumn("v", F.col("pid") * 2)}
    steps = [
        *CONTACTS,
        step("drop_rows_by_condition", column="country", operator="==", value="CA"),
        step("fill_missing", column="amount", strategy="median"),
        step("clip_outliers", column="amount", threshold=0.1),
        step("fix_referential_integrity", child_column="contact_id", parent_table="p", parent_column="pid"),
        step("merge_tables", right_table="p", left_on="contact_id", right_on="pid", how="left"),
    ]
    stats = freeze_stats(static, [s for s in steps if s["action_type"] in ("fill_missing", "clip_outliers")])
    assert set(stats) == {Need("amount", MEDIAN), Need("amount", QUARTILES)}
    got = drain(spark, clean_stream(stream, steps, tables, stats), tmp_path)
    want = run_plan(static, steps, tables, stats=stats).df
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(
    "bad",
    [
        step("drop_duplicates"), step("fill_missing", column="amount", strategy="forward_fill"),
        step("fill_missing", column="amount", strategy="median"), step("clip_outliers", column="amount"),
        step("drop_column", column="no"),
    ],
)
def test_stream_refuses(contacts, bad):
    with pytest.raises(CleaningError):
        clean_stream(contacts[1], [bad])


# --- injection ------------------------------------------------------------------------------------------------


def test_draws_do_not_depend_on_partitions(spark):
    keys = spark.range(1, 2001)
    for build in (inject.gen_people, inject.gen_contacts, inject.gen_customers):
        one, many = build(keys.repartition(1), "id"), build(keys.repartition(7), "id")
        assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    assert inject.gen_people(keys, "id", 1).exceptAll(inject.gen_people(keys, "id", 2)).count() > 0


def test_shares(spark):
    keys = spark.range(1, 20_001)
    people = inject.gen_people(keys, "id")
    n = people.count()
    assert abs(n / 20_000 - 1.08) < 0.01 and people.distinct().count() == 20_000
    row = people.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in ("age", "email", "salary")]).first()
    assert all(abs(row[c] - share) < 0.01 for c, share in (("age", 0.15), ("email", 0.12), ("salary", 0.10)))
    clean, dirty = inject.gen_orders(keys, "id", 100, dirty=False), inject.gen_orders(keys, "id", 100)
    joined = dirty.where("order_id <= 20000").alias("d").join(clean.alias("c"), "order_id")
    shares = joined.agg(
        F.avg((F.col("d.customer_id") > 100).cast("int")), F.avg((F.col("d.price") != F.col("c.price")).cast("int")),
        F.avg((F.col("d.quantity") != F.col("c.quantity")).cast("int")),
    ).first()
    assert all(abs(got - want) < 0.01 for got, want in zip(shares, (0.10, 0.05, 0.05)))
    assert inject.shuffle_rows(clean, "order_id").exceptAll(clean).count() == 0
    first = [r[0] for r in inject.shuffle_rows(clean, "order_id").select("order_id").take(50)]
    assert first != sorted(first)


def test_injection_refuses(spark):
    df = spark.range(3)
    for bad in (lambda: inject.inject_nulls(df, "id", 1.5, "id"), lambda: inject.inject_case(df, "id", "id", cases=("odd",)),
                lambda: inject.inject_nulls(df, "no", 0.1, "id")):
        with pytest.raises(CleaningError):
            bad()


def test_frozen_statistics_belong_to_their_step(spark):
    """A column measured twice: before and after its gaps were filled."""
    history = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)] * 10, "x double")
    steps = [
        {"action_type": "clip_outliers", "parameters": {"column": "x", "method": "zscore", "threshold": 1}},
        {"action_type": "fill_missing", "parameters": {"column": "x", "strategy": "constant", "fill_value": 100.0}},
        {"action_type": "clip_outliers", "parameters": {"column": "x", "method": "zscore", "threshold": 1}},
    ]
    frozen = freeze_steps(history, steps)
    with pytest.raises(CleaningError):
        freeze_stats(history, steps)
    assert [len(f) for f in frozen] == [2, 0, 2] and frozen[0] != frozen[2]
    assert sorted(r.x for r in clean_stream(history, steps, stats=frozen).collect()) == sorted(r.x for r in run_plan(history, steps).df.collect())
    with pytest.raises(CleaningError):
        clean_stream(history, steps, stats=frozen[:1])
