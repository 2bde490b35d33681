"""Language identification: held-out accuracy, and what is defined for awkward rows."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from burnish.llm import language

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    found = language.op4_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    assert found.count() == docs.count() and found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    right = found.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def rows(spark, texts):
    return spark.createDataFrame([(i, t, lang, "s", 0.5) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string, lang_pred string, score double")


SMALL = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 8


def test_awkward_texts(spark):
    model = language.train(rows(spark, SMALL + [(None, "en"), ("123", "xx")]).where("text IS NOT NULL"))
    assert model.languages == ["de", "en", "fr"]
    texts = [None, "", "  ", "12 !?", "the dog", "und die", "日本語", "Ünd\x00", "x" * 200_000, "the dog"]
    got = {r.doc_id: r for r in language.identify(rows(spark, [(t, None) for t in texts]), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und"] * 4 + ["en", "de"]
    assert all(got[i].score == 0 for i in range(4)) and all(0 < got[i].score <= 1 for i in range(4, 10))
    assert (got[4].lang_pred, got[4].score) == (got[9].lang_pred, got[9].score)


def test_number_signs_are_no_letters(spark):
    model = language.train(rows(spark, SMALL))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(rows(spark, [("½", None), ("²③", None), ("1ª", None)]), model).collect()}
    assert got[0] == got[1] == ("und", 0.0) and got[2][0] != "und"


def test_nothing_to_learn_from_and_empty_table(spark):
    none = language.train(rows(spark, SMALL).where("doc_id < 0"))
    assert [r.lang_pred for r in language.identify(rows(spark, [("a", None)]), none).collect()] == ["und"]
    assert language.identify(rows(spark, SMALL).where("doc_id < 0"), none).count() == 0


def test_weights_are_sparse_and_temperature_lowers_the_loss():
    rng = np.random.default_rng(3)
    idf = np.ones(language.BUCKETS)
    words = {0: "alpha beta gamma", 1: "delta epsilon zeta"}
    data = [(*language.weigh(" ".join(rng.permutation(words[y].split())), idf), y) for y in rng.integers(0, 2, 200)]
    weights, bias = language.fit_ftrl(data, 2)
    assert (weights != 0).any(axis=1).mean() < 0.01
    logits = np.array([v @ weights[at] + bias for at, v, _ in data])
    assert (logits.argmax(axis=1) == [d[2] for d in data]).all()
    over = rng.standard_normal((2000, 3)) * 5
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(over / 3)])
    t = language.temperature_of(over, labels)
    loss = lambda t: -np.log(language.softmax(over / t)[np.arange(2000), labels]).mean()
    assert loss(t) < min(loss(1.0), loss(0.5 * t), loss(1.3 * t)) + 1e-3


def test_counts_are_of_all_grams():
    assert language.counts("").sum() == 0
    assert language.counts("abcd").sum() == 4 + 3 + 2
    assert (language.counts("ABCD") == language.counts("abcd")).all()


def test_learning_rows_leave_the_held_out_alone(spark):
    from zlib import crc32

    found = {r.doc_id for r in language.learning_rows(rows(spark, SMALL)).collect()}
    assert found == {i for i in range(len(SMALL)) if crc32(str(i).encode()) % 4 != 2}
