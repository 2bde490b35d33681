"""Neighbours by codes against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int, score string, vector string"


def brute(vectors, queries, k=10):
    out = []
    for q in queries:
        own = [v for i, v in vectors if i == q]
        rows = sorted((float(np.sqrt(((np.array(v) - np.array(own[0])) ** 2).sum())), i) for i, v in vectors if i != q)
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(rows[:k])]
    return out


def same(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_ties_copies_and_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(x)) for x in rng.standard_normal(12)]) for i in range(300)]
    good += [(300 + i, good[0][1]) for i in range(40)]
    bad = [(1000, None), (1100, [0.0] * 12), (1200, [None] + [1.0] * 11), (1300, [float("nan")] * 12), (1400, [float("inf")] * 12)]
    bad += [(1500, [1.0] * 5), (1600, []), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v, 1, "s", "v") for i, v in good + bad], SCHEMA)
    same(nb.nearest(df, F.col("vec_id") % 100 == 0, block=64).collect(), brute(good, [0, 100, 200, 300]))


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0, None, None) for i in (0, 1, 2)], SCHEMA)
    same(nb.nearest(df, F.col("vec_id") == 0).collect(), [(0, 1, 1, 1.0), (0, 2, 2, 2.0)])
    assert nb.nearest(df.where("vec_id > 5"), F.col("vec_id") == 0).count() == 0
    assert nb.nearest(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_bounds_hold_and_rerank_few():
    rng = np.random.default_rng(2)
    v, q = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    mean = v.mean(axis=0)
    low, high = nb.bounds(*nb.encode(v, mean), q, mean)
    exact = ((q[:, None] - v) ** 2).sum(axis=2)
    assert ((low <= exact) & (exact <= high)).mean() > 0.99
    assert ((low <= np.partition(high, 9, axis=1)[:, 9:10]).mean()) < 0.95


def test_recall_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    pytest.importorskip("os").path.isdir(sf) or pytest.skip("no test tables")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    got = {(r.query_id, r.vec_id) for r in nb.op3_nearest_neighbours(spark, sf).collect()}
    assert len(got & {(w[0], w[2]) for w in want}) >= 0.98 * len(want)
