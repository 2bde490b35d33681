"""The ways for large data, forced on small tables and compared with brute force; and the plans they lead to."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.operators import keyfilter, stats
from burnish.operators.joining import JoinLimits, equi_join, hot_keys, is_small, lookup
from burnish.operators.missing import fill_missing
from burnish.operators.outliers import clip_outliers
from burnish.operators.ordered import fill_from_neighbour, ranked_values, sample_values
from burnish.operators.references import fix_referential_integrity, merge_tables
from burnish.operators.rows import drop_duplicates, drop_rows_by_condition
from burnish.operators.scratch import settle
from burnish.operators.stats import MEDIAN, QUARTILES, Need, measure
from burnish.quality.profile import column_profile
from burnish.queries.registry import read
from shuffles import exchanges

SF_DIR = "/root/testdata/sf0.001"
NEVER_SMALL = JoinLimits(broadcast_bytes=-1, hot_rows=10)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def skewed(spark, seed, n, prefix):
    """A third of the rows shares key 1, another part has no key."""
    rng = random.Random(seed)
    keys = [1 if rng.random() < 0.34 else None if rng.random() < 0.15 else rng.randint(2, 60) for _ in range(n)]
    rows = [(k, f"{prefix}{i % 50}") for i, k in enumerate(keys)]
    return rows, spark.createDataFrame(rows, f"{prefix}k int, {prefix}v string").repartition(6)


def brute(left, right, how, null_safe):
    hit = lambda a, b: a == b if null_safe else (a is not None and a == b)
    rows = [(*a, *b) for a in left for b in right if hit(a[0], b[0])]
    if how in ("left", "outer"):
        rows += [(*a, None, None) for a in left if not any(hit(a[0], b[0]) for b in right)]
    if how in ("right", "outer"):
        rows += [(None, None, *b) for b in right if not any(hit(a[0], b[0]) for a in left)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("hot_right", [True, False])
def test_salted_joins(spark, how, null_safe, hot_right):
    left_rows, left = skewed(spark, 1, 150, "l")
    if hot_right:
        right_rows, right = skewed(spark, 2, 120, "r")
    else:
        right_rows = [(k, f"r{k}") for k in (None, *range(1, 90, 3))]
        right = spark.createDataFrame(right_rows, "rk int, rv string")
    joined = equi_join(left, right, "lk", "rk", how, null_safe, NEVER_SMALL)
    got = sorted((tuple(r) for r in joined.select("lk", "lv", "rk", "rv").collect()), key=repr)
    assert got == brute(left_rows, right_rows, how, null_safe)
    small = equi_join(left, right, "lk", "rk", how, null_safe)
    assert sorted((tuple(r) for r in small.select("lk", "lv", "rk", "rv").collect()), key=repr) == got


def test_hot_rows_are_spread_out(spark):
    _, left = skewed(spark, 1, 400, "l")
    right = spark.range(100).select(F.col("id").cast("int").alias("rk"), F.lit("x").alias("rv"))
    hot = {r["key"]: r["salts"] for r in hot_keys(left, "lk", NEVER_SMALL).collect()}
    sizes = {r["lk"]: r["count"] for r in left.groupBy("lk").count().collect()}
    assert hot == {k: -(-n // 10) for k, n in sizes.items() if n > 10} and max(hot.values()) > 10
    assert {r["key"] for r in hot_keys(left, "lk", JoinLimits(-1, 10, list_bytes=1)).collect()} == {1}
    assert hot_keys(left, "lk", JoinLimits(-1, 1000)) is None
    joined = equi_join(left, right, "lk", "rk", "inner", False, NEVER_SMALL)
    assert "__la" in plan(joined) and "explode" in plan(joined)
    assert "__la" not in plan(equi_join(left, right, "lk", "rk", "inner", False, JoinLimits(broadcast_bytes=-1)))


@pytest.mark.parametrize("action", ["drop", "flag"])
def test_salted_foreign_keys(spark, action):
    rows, child = skewed(spark, 3, 300, "l")
    parents = spark.createDataFrame([(k,) for k in (1, 1, 5, 9, None)], "id int")
    args = (child, "lk", "p", "id", action, {"p": parents})
    big, small = fix_referential_integrity(*args, limits=NEVER_SMALL), fix_referential_integrity(*args)
    got = sorted(map(tuple, big.collect()), key=repr)
    assert got == sorted(map(tuple, small.collect()), key=repr)
    valid = [r[0] in (1, 5, 9) for r in rows]
    assert len(got) == (sum(valid) if action == "drop" else len(rows))
    anti = lookup(child, parents.withColumnRenamed("id", "p"), "lk", "p", "left_anti", limits=NEVER_SMALL)
    assert anti.count() == len(rows) - sum(valid)


def test_small_is_counted(spark):
    df = spark.range(1000).select(F.repeat(F.lit("x"), 100).alias("s"))
    assert is_small(df, 200_000) and not is_small(df, 100_000) and not is_small(df, 1_000)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("groups", [[], ["g"]])
@pytest.mark.parametrize("order", [["t"], ["name", "t"], ["tie", "t"], ["ts"]])
def test_fill_over_ranges(spark, forward, groups, order):
    rng = random.Random(5)
    rows = [(t, f"n{t:04d}", 1, "d" if t % 50 == 0 else None if t % 40 == 0 else rng.choice("aaab"), rng.randint(1, 9) if rng.random() < 0.1 else None) for t in range(500)]
    df = spark.createDataFrame(rows, "t int, name string, tie int, g string, x int").repartition(7)
    df = df.withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01' + make_interval(0, 0, 0, 0, 0, t, 0)"))
    key = lambda d: sorted((r["t"], r["x"]) for r in d.collect())
    plain = fill_from_neighbour(df, "x", order, forward, groups)
    ranged = fill_from_neighbour(df, "x", order, forward, groups, max_group_rows=40)
    assert ranged.columns == df.columns and key(ranged) == key(plain)
    assert "__range" in plan(ranged) and "__range" not in plan(plain)


def test_more_hot_keys_than_a_list_could_hold(spark):
    left = spark.range(9000).select((F.col("id") % 3000).cast("int").alias("lk"), F.col("id").alias("lv"))
    right = spark.range(3000).select(F.col("id").cast("int").alias("rk"), F.lit("x").alias("rv"))
    limits = JoinLimits(broadcast_bytes=-1, hot_rows=1)
    assert hot_keys(left, "lk", limits).count() == 3000
    assert equi_join(left, right, "lk", "rk", "inner", True, limits).count() == 9000
    one = left.withColumn("lk", F.lit(7))
    assert hot_keys(one, "lk", JoinLimits(-1, 100)).first()["salts"] == 90
    assert equi_join(one, right, "lk", "rk", "outer", True, JoinLimits(-1, 100)).count() == 9000 + 2999


def test_types_do_not_depend_on_size(spark):
    df = spark.createDataFrame([(f"w{i}",) for i in range(300)], "w string")
    assert ranked_values(df, "w", "c").dtypes == ranked_values(df, "w", "c", max_group_rows=20).dtypes == [("w", "string"), ("c", "bigint")]


@pytest.mark.parametrize("blocks", [2, 1000])
def test_blocks_of_ranges(spark, monkeypatch, blocks):
    monkeypatch.setattr("burnish.operators.ordered.BLOCK_OF_RANGES", blocks)
    monkeypatch.setattr("burnish.operators.ordered.LIST_BYTES", -1)
    df = spark.range(400).select(F.col("id").alias("t"), F.when(F.col("id") % 97 == 0, F.col("id")).alias("x"), (F.col("id") % 2).alias("g"))
    for groups in ([], ["g"]):
        got = {r["t"]: r["x"] for r in fill_from_neighbour(df, "x", ["t"], True, groups, max_group_rows=20).collect()}
        plain = {r["t"]: r["x"] for r in fill_from_neighbour(df, "x", ["t"], True, groups).collect()}
        assert got == plain
    ranks = {r["t"]: r["c"] for r in ranked_values(df, "t", "c", max_group_rows=20).collect()}
    assert ranks == {i: i for i in range(400)}


def test_ranks_over_ranges(spark):
    words = [f"w{i * 7919 % 1000:04d}" for i in range(600)]
    df = spark.createDataFrame([(w,) for w in words * 2 + [None]], "w string")
    got = {r["w"]: r["c"] for r in ranked_values(df, "w", "c", max_group_rows=50).collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


@pytest.mark.parametrize("shape", ["uniform", "heavy", "ties"])
def test_exact_quantiles_by_narrowing(spark, monkeypatch, shape):
    rng = np.random.default_rng(3)
    values = {
        "uniform": rng.uniform(0, 1, 20_000),
        "heavy": np.exp(rng.normal(0, 6, 20_000)),
        "ties": np.where(rng.uniform(0, 1, 20_000) < 0.4, 7.0, rng.uniform(0, 20, 20_000)),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
    want = np.quantile(values, [0.25, 0.5, 0.75])
    for limits in ({}, {"FEW_ROWS": 10}, {"MAX_DISTINCT": 50}, {"MAX_DISTINCT": 50, "GUIDE_ROWS": 500}):
        for name, value in limits.items():
            monkeypatch.setattr(stats, name, value)
        got = measure(df, [Need("x", QUARTILES), Need("x", MEDIAN)])
        low, high = got[Need("x", QUARTILES)]
        assert np.allclose([low, got[Need("x", MEDIAN)], high], want, rtol=1e-12, atol=0)


def test_samples_of_sparse_columns(spark):
    df = spark.range(500).select("id", F.when(F.col("id") > 490, F.col("id")).alias("late"), F.lit(None).cast("int").alias("no"))
    got = {r[0]: r[1] for r in sample_values(df, ["id"]).collect()}
    assert got == {"id": ["0", "1", "2", "3", "4"], "late": ["491", "492", "493", "494", "495"], "no": []}


def test_same_result_for_any_partitioning(spark):
    orders = read(spark, SF_DIR, "orders")
    kept = [
        sorted(r[0] for r in drop_duplicates(orders.repartition(p), ["o_custkey"], "first", ["o_orderkey"]).select("o_orderkey").collect())
        for p in (1, 8)
    ]
    assert kept[0] == kept[1] and len(kept[0]) == orders.select("o_custkey").distinct().count()


# --- plans ----------------------------------------------------------------------------------------------------


def test_a_profile_runs_what_precedes_it_once(spark):
    df = read(spark, SF_DIR, "orders").dropDuplicates(["o_custkey"])
    profile = plan(column_profile(df, ["o_orderkey"]))
    assert "burnish-" in profile and "orders.parquet" not in profile
    assert "orders.parquet" in plan(column_profile(read(spark, SF_DIR, "orders"), ["o_orderkey"]))


def test_first_duplicate_is_limited_before_the_shuffle(spark):
    df = drop_duplicates(read(spark, SF_DIR, "orders"), ["o_custkey"], "first", ["o_orderkey"])
    assert plan(df).count("WindowGroupLimit") >= 2


def test_copies_are_counted_before_the_shuffle(spark, monkeypatch):
    assert "WindowGroupLimit" in plan(drop_duplicates(read(spark, SF_DIR, "orders"), ["o_custkey"], "none"))
    written = []
    monkeypatch.setattr(stats, "settle", lambda df: written.append(plan(df)) or settle(df))
    stats.duplicate_count(read(spark, SF_DIR, "documents"))
    counted = written[0]
    hashed = [line for line in counted.splitlines() if "hashpartitioning(__h1" in line]
    assert hashed and "partial_count" in counted


@pytest.mark.parametrize("bits", [0, 1])
def test_rows_of_one_hash_are_compared(spark, monkeypatch, bits):
    monkeypatch.setattr(stats, "row_hash", lambda cells: [(F.xxhash64(*cells) % (bits + 1)).alias("__h1"), F.lit(0).alias("__h2")])
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (1, None), (1, None), (1, None)], "x int, y string")
    assert stats.duplicate_count(df).first().asDict() == {"duplicate_rows": 3, "total_rows": 6}


@pytest.mark.parametrize("shape", ["uniform", "ends", "gap"])
def test_quantiles_at_the_ends_come_to_an_end(spark, monkeypatch, shape):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 1, 6000)
    if shape == "ends":
        x[:2900], x[2900:5800] = 0.0, 1.0
    if shape == "gap":
        x[:3000] += 1e9
    monkeypatch.setattr(stats, "MAX_DISTINCT", 40)
    monkeypatch.setattr(stats, "GUIDE_ROWS", 300)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    shares = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    got = stats.quantiles(df, {"x": shares})[0]["x"]
    assert np.allclose([got[p] for p in shares], np.quantile(x, shares))


def test_checked_tables_are_broadcast(spark):
    tables = {"c": read(spark, SF_DIR, "customer")}
    orders = read(spark, SF_DIR, "orders")
    for df in (
        merge_tables(orders, "c", "o_custkey", "c_custkey", "left", ["c_mktsegment"], tables),
        fix_referential_integrity(orders, "o_custkey", "c", "c_custkey", "drop", tables),
    ):
        assert "BroadcastHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)
        assert "ReadSchema: struct<c_custkey:bigint" in plan(df) or "c_custkey" in plan(df)


def test_conditions_reach_the_scan(spark):
    orders, events = read(spark, SF_DIR, "orders"), read(spark, SF_DIR, "events")
    assert "PushedFilters: [Or(Not(EqualTo(o_custkey,5)),IsNull(o_custkey))]" in plan(
        drop_rows_by_condition(orders, "o_custkey", "==", 5)
    )
    dropped = plan(clip_outliers(events, "value", "drop", bounds=(1, 9)).select("event_id"))
    assert "GreaterThanOrEqual(value,1.0), LessThanOrEqual(value,9.0)" in dropped
    assert "ReadSchema: struct<event_id:bigint,value:double>" in dropped


def test_row_wise_steps_need_no_shuffle(spark):
    df = read(spark, SF_DIR, "customer")
    df = fill_missing(df, "c_mktsegment", "unknown")
    df = clip_outliers(df, "c_acctbal", bounds=(0, 1000))
    assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_settled_results_keep_their_rows(spark):
    df = spark.range(10).select("id", F.when(F.col("id") > 5, F.col("id")).alias("x"))
    again = settle(df)
    assert again.columns == df.columns and again.count() == 10
    assert "ReadSchema: struct<x:bigint>" in plan(again.agg(F.sum("x")))



# --- packed filters -------------------------------------------------------------------------------------------


@pytest.fixture
def unhinted(spark):
    """Nothing is broadcast unless the library says so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_filter_never_misses_a_key(spark, monkeypatch):
    monkeypatch.setattr(keyfilter, "SLICE_WORDS", 32)
    keys = spark.range(0, 6000, 3)
    filter_ = keyfilter.packed_filter(keys.select(keyfilter.hash_of([F.col("id")])))
    assert filter_.count() == 16 and {len(r["__words"]) for r in filter_.collect()} == {32}
    marked = keyfilter.marked(spark.range(6000), [F.col("id")], filter_, "maybe")
    assert marked.columns == ["id", "maybe"]
    held = {r.id for r in marked.where("maybe").collect()}
    assert set(range(0, 6000, 3)) <= held and len(held) < 2200
    monkeypatch.setattr(keyfilter, "MAX_SLICES", 1)
    full = keyfilter.packed_filter(keys.select(keyfilter.hash_of([F.col("id")])))
    assert full.count() == 1 and keyfilter.marked(keys, [F.col("id")], full, "maybe").where("maybe").count() == 2000
    none = keyfilter.packed_filter(keys.where("false").select(keyfilter.hash_of([F.col("id")])))
    assert keyfilter.marked(keys, [F.col("id")], none, "maybe").where("maybe").count() == 0


@pytest.mark.parametrize("hot_rows", [10, 10**9])
@pytest.mark.parametrize("limit", [-1, 0, 10**9])
def test_only_rows_that_may_lack_their_parent_move(spark, unhinted, hot_rows, limit):
    """A hot key with a parent and one without; null keys; ten per cent of the rows lack their parent."""
    rows = [(1 if i % 3 == 0 else 777 if i % 11 == 0 else None if i % 7 == 0 else i % 900, f"row {i}") for i in range(9000)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(6)
    parents = spark.createDataFrame([(i,) for i in range(870) if i != 777] * 2, "p bigint")
    # A limit that takes the keys to be large, and the absent ones to be small or large.
    limits = JoinLimits(broadcast_bytes=limit, hot_rows=hot_rows)
    has = lambda k: k is not None and k < 870 and k != 777
    lacking = sum(1 for k, _ in rows if k is not None and not has(k))
    want = {
        "left_semi": sorted((k, v) for k, v in rows if has(k)),
        "left_anti": sorted(((k, v) for k, v in rows if not has(k)), key=repr),
        "left": sorted(((k, v, k if has(k) else None) for k, v in rows), key=repr),
    }
    for how, expected in want.items():
        got = lookup(df, parents, "k", "p", how, limits=limits)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
        moved = [n for columns, n in exchanges(got) if "v" in columns]
        assert sum(moved) <= (3 * lacking if limit <= 0 else 9000 + 9000)


def test_null_keys_match_where_they_may(spark, unhinted):
    rows = [(None, "a"), (1, "b"), (2, "c"), (None, "d")]
    df = spark.createDataFrame(rows, "k int, v string")
    for keys, want in (([None, 1], ["a", "b", "d"]), ([1], ["b"]), ([], [])):
        parents = spark.createDataFrame([(k,) for k in keys], "p int")
        for limit in (-1, 10**6):
            got = lookup(df, parents, "k", "p", "left_semi", True, JoinLimits(broadcast_bytes=limit))
            assert sorted(r.v for r in got.collect()) == want
            rest = lookup(df, parents, "k", "p", "left_anti", True, JoinLimits(broadcast_bytes=limit))
            assert sorted(r.v for r in rest.collect()) == sorted({"a", "b", "c", "d"} - set(want))


@pytest.mark.parametrize("limit", [0, 1 << 24])
def test_only_repeated_rows_move_to_be_compared(spark, unhinted, monkeypatch, limit):
    monkeypatch.setattr(stats, "REPEATS_BYTES", limit)
    rows = [(i, f"text {i}", i / 2) for i in range(4000)] + [(7, "text 7", 3.5)] * 500 + [(None, None, float("nan"))] * 3 + [(None, None, None)] * 2
    df = spark.createDataFrame(rows, "x int, `a.text` string, f double").repartition(5)
    found = stats.duplicate_count(df)
    assert found.first().asDict() == {"duplicate_rows": 504, "total_rows": 4505}
    for columns, n in exchanges(found):
        assert n <= 600 or not any(c.startswith("c") for c in columns), (columns, n)
    alone = stats.duplicate_count(df.where("x BETWEEN 10 AND 2000"))
    assert alone.first().asDict() == {"duplicate_rows": 0, "total_rows": 1991} and not exchanges(alone)
    assert stats.duplicate_count(df.where("false")).first().asDict() == {"duplicate_rows": 0, "total_rows": 0}
