"""The byte network: scoring and gradients against plain versions, held-out accuracy, awkward rows."""

from __future__ import annotations

import os

import numpy as np
import pytest

from burnish.llm import byte_network as b

SF = "/root/testdata/sf0.01"


def network(seed=1, kind=np.float32):
    rng = np.random.default_rng(seed)
    shapes = [(256, b.DEPTH), (b.WIDTH * b.DEPTH, b.FILTERS), (b.FILTERS,), (2 * b.FILTERS,)]
    return b.Network(*[rng.normal(size=s, scale=0.3).astype(kind) for s in shapes], 0.1)


def plain(net, text):
    """The definition, window by window and chunk by chunk."""
    text = text or b"\0"
    padded = text + bytes(b.WIDTH)
    answers = [np.concatenate([net.bytes[x] for x in padded[i : i + b.WIDTH]]) @ net.filters + net.bias for i in range(len(text))]
    cells = [np.max(answers[i : i + b.CELL], axis=0) for i in range(0, len(answers), b.CELL)]
    chunks, start = [], 0
    while True:
        chunks.append(np.maximum(np.max(cells[start : start + b.CELLS_PER_CHUNK], axis=0), 0))
        if start + b.CELLS_PER_CHUNK >= len(cells):
            break
        start += b.STEP
    z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.out + net.intercept
    return 1 / (1 + np.exp(-z))


def texts(seed=2):
    rng = np.random.default_rng(seed)
    sizes = [0, 1, 5, 7, 8, 57, 63, 64, 65, 128, 505, 512, 513, 960, 961, 1024, 5000]
    return [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in sizes]


@pytest.mark.parametrize("portion", [64, 1 << 10, 1 << 18])
def test_scores_like_the_plain_version(monkeypatch, portion):
    monkeypatch.setattr(b.portions, "__defaults__", (portion,))
    net = network()
    assert np.allclose(net.score(texts()), [plain(net, t) for t in texts()], atol=2e-5)
    assert net.score([]).shape == (0,)


def test_gradients_are_slopes():
    net, some, labels, weights = network(3, np.float64), texts()[3:], np.arange(14) % 2, np.linspace(0.5, 1.5, 14)
    found = net.gradients(some, labels.astype(float), weights)

    def loss():
        p = np.array([plain(net, t) for t in some])
        return -(weights * np.log(np.where(labels == 1, p, 1 - p))).sum()

    rng = np.random.default_rng(4)
    for values, slopes in zip((net.bytes, net.filters, net.bias, net.out), found, strict=False):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in values.shape)
            old, step = values[at], 1e-4
            values[at] = old + step
            up = loss()
            values[at] = old - step
            down = loss()
            values[at] = old
            assert slopes[at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=0.02)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    found = b.op12_quality_network(spark, SF)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert found.count() == docs.count()
    rows = found.join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.95
    assert (rows[rows.quality == 0].predicted == 0).mean() > 0.8
    assert ((found.toPandas().score >= 0.5).astype(int) == found.toPandas().predicted).all()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", 0.1) for i, t in rows], "doc_id long, text string, key string, score double")


def test_awkward_rows(spark):
    good, bad = "the cat sat on the mat and ate", "#### $$$$ !!!! %%%%"
    rows = [(i, f"{good if i % 2 else bad} {i % 30}") for i in range(80)] + [(None, good), (7, None), (7, ""), (90, "y" * 300_000), (91, bad), (91, bad)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 0), (7, 0), (90, None), (91, 5), (92, 1)], "doc_id long, quality int")
    net = b.train(frame(spark, rows), labels)
    got = b.score(frame(spark, rows), net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] > 0.5 > by[0]
    assert len({r.score for r in got if r.doc_id == 91}) == 1
    assert b.score(frame(spark, rows).where("false"), net).count() == 0


def test_nothing_to_learn_from(spark):
    docs, labels = frame(spark, [(1, "a"), (2, None)]), spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert {r.score for r in b.score(docs, b.train(docs, labels)).collect()} == {1.0}
    assert {r.score for r in b.score(docs, b.train(docs, labels.where("false"))).collect()} == {0.5}
