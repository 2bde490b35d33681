"""Sketches of parts give the profile of the whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from burnish.errors import CleaningError
from burnish.quality.sketches import column_sketches, merge_sketches, profile_of

SHARES = (0.0, 0.1, 0.5, 0.9, 1.0)


@pytest.fixture(scope="module")
def table(spark):
    """A hot part with a third of the rows, many different numbers, few words, gaps and NaN."""
    i = F.col("id")
    return spark.range(60_000).select(
        F.when(i % 3 == 0, 0).otherwise(i % 40).alias("part"),
        (F.xxhash64(i) % 1_000_000).cast("double").alias("x"),
        F.when(i % 5 > 0, F.concat(F.lit("w"), F.least(i % 50, F.lit(20)))).alias("w"),
        F.when(i % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("n"),
        F.lit(None).cast("string").alias("nothing"),
    )


def test_parts_merge_to_the_whole(spark, table, tmp_path):
    path = str(tmp_path / "sketches")
    column_sketches(table.where("part < 7"), part_by=["part"]).write.parquet(path)
    column_sketches(table.where("part >= 7"), part_by=["part"]).write.mode("append").parquet(path)
    kept = spark.read.parquet(path)
    assert kept.select("part").distinct().count() == table.select("part").distinct().count()
    got = {r.column_name: r for r in profile_of(merge_sketches(kept), SHARES, 3).collect()}
    whole = {r.column_name: r for r in profile_of(column_sketches(table.drop("part")), SHARES, 3).collect()}
    assert set(got) == {"x", "w", "n", "nothing"}
    for name, row in got.items():
        assert (row["values"], row.nulls, row.low, row.high) == tuple(whole[name][k] for k in ("values", "nulls", "low", "high"))
    exact = table.agg(F.countDistinct("x"), F.min("x"), F.max("x"), F.avg("x")).first()
    assert abs(got["x"].distinct_values / exact[0] - 1) < 0.05
    assert (got["x"].low, got["x"].high) == (exact[1], exact[2]) and got["x"].mean == pytest.approx(exact[3])
    for share, value in zip(SHARES, got["x"].quantiles):
        below = table.where(F.col("x") <= value).count() / 60_000
        assert abs(below - share) < 0.02
    words = [tuple(r) for r in table.where("w IS NOT NULL").groupBy("w").count().orderBy(F.desc("count"), "w").collect()]
    assert got["w"].distinct_values == len(words) == 17
    assert tuple(got["w"].most_frequent[0]) == words[0] and {r["count"] for r in got["w"].most_frequent[1:]} == {words[1][1]}
    assert (got["n"]["values"], got["n"].nulls, got["n"].quantiles) == (30_000, 30_000, [1.0] * 5)
    nothing = got["nothing"]
    assert (nothing["values"], nothing.nulls, nothing.distinct_values) == (0, 60_000, 0)
    assert nothing.quantiles is None and nothing.most_frequent is None and nothing.mean is None


def test_empty_table_and_other_types(spark):
    empty = spark.createDataFrame([], "a int, b string")
    rows = profile_of(merge_sketches(column_sketches(empty), column_sketches(empty))).collect()
    assert [(r["values"], r.nulls, r.distinct_values, r.quantiles) for r in rows] == [(0, 0, 0, None)] * 2
    assert column_sketches(empty, part_by=["b"]).count() == 0
    some = spark.sql("SELECT DATE'2021-01-01' AS d, true AS b, CAST(2.5 AS DECIMAL(5,2)) AS m, '7' AS t")
    got = {r.column_name: r for r in profile_of(column_sketches(some)).collect()}
    assert [got[c].low for c in "dbmt"] == [None, 1.0, 2.5, 7.0]
    assert tuple(got["d"].most_frequent[0]) == ("2021-01-01", 1)


def test_refuses(spark):
    df = spark.range(1)
    for bad in (
        lambda: column_sketches(df, ["no"]), lambda: column_sketches(df, part_by=["id"]),
        lambda: profile_of(column_sketches(df), [1.5]), lambda: profile_of(column_sketches(df), most_frequent=0),
    ):
        with pytest.raises(CleaningError):
            bad()
