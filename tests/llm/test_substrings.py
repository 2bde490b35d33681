"""Removal of repeated word sequences against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from burnish.llm import substrings as ss


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, span=20):
    first = {}
    for i, text in rows:
        words = words_of(text)
        for s in range(len(words) - span + 1):
            key = tuple(words[s : s + span])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, text in rows:
        words = words_of(text)
        gone = set()
        for s in range(len(words) - span + 1):
            if first[tuple(words[s : s + span])] < (i, s):
                gone.update(range(s, s + span))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdéfgh") + str(rng.randrange(300))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 35, 60)]
    texts = [None, "", " \n", "one", "x " * 19, "x " * 20, "x " * 21, "x\ty\n" * 50, "p q r " * 40, "A a " * 30]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [word() for _ in range(rng.randrange(30))] + (rng.choice(passages) if rng.random() < 0.5 else [])
            if rng.random() < 0.2:
                words += [word()] * rng.randrange(15, 60)
        texts.append(rng.choice([" ", "  ", "\n", "\t "]).join(words))
        if rng.random() < 0.2:
            texts.append(texts[-1])
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "a", "b") for i, t in rows], "doc_id long, text string, start int, anchor string, n string")


def result(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    out = ss.remove_repeats(frame(spark, rows))
    assert result(out) == brute(rows)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in out.collect())


@pytest.mark.parametrize("small", [3, 200_000])
def test_frequent_anchors_and_large_sides(spark, monkeypatch, small):
    monkeypatch.setattr("burnish.llm.common.HOT_ROWS", 5)
    monkeypatch.setattr("burnish.llm.common.is_small.__defaults__", (small,))
    monkeypatch.setattr(ss, "TOGETHER", 50)
    rows = corpus(3)
    assert result(ss.remove_repeats(frame(spark, rows), with_text=False)) == brute(rows)


def test_colliding_hashes_are_found_by_verification(spark, monkeypatch):
    real = ss.windows
    texts = ss._texts(frame(spark, corpus(1)), "doc_id", "text")
    spans = ss.repeated_spans(texts, 20, 10)
    wrong = spans.withColumn("source_start", F.col("source_start") + F.when(F.col("start") % 2 == 0, 1).otherwise(0))
    kept = ss.verified(texts, wrong, 20)
    assert real is ss.windows and kept.where("start % 2 = 1").count() == spans.where("start % 2 = 1").count()
    assert kept.where("start % 2 = 0 AND NOT (doc_id = source_id)").count() == 0


def test_paths_cover_the_sources(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(a, b))) for i, (a, b) in enumerate([(0, 100), (0, 50), (30, 100), (200, 230)])]
    spans = ss.repeated_spans(ss._texts(frame(spark, rows), "doc_id", "text"), 20, 10)
    got = sorted((r.source_id, r.start, r.n, r.spans) for r in ss.paths(spans).collect())
    assert got == [(0, 0, 30, 1), (0, 30, 1, 2), (0, 31, 50, 1)]


def test_empty_table_null_and_repeated_ids(spark):
    assert ss.remove_repeats(frame(spark, [])).count() == 0
    text = " ".join(map(str, range(30)))
    rows = [(None, text), (4, text), (4, text), (5, "z " + text), (4, "other words")]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in ss.remove_repeats(frame(spark, rows)).collect())
    assert got == [("4", 2, 0), ("4", 30, 30), ("4", 30, 30), ("5", 31, 30), ("None", 30, 0)]
