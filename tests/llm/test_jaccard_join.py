"""The similarity join against brute force over all pairs."""

from __future__ import annotations

import random
import re

import pytest

from burnish.llm import jaccard_join as jj


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows):
    """{(doc_id, n_shingles, component_id)} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    heads = {}
    for a, (i, _) in enumerate(sets):
        heads[find(a)] = min(i, heads.get(find(a), i))
    return sorted((i, len(s), heads[find(a)]) for a, (i, s) in enumerate(sets))


def corpus(seed=1, groups=25):
    """Documents with copies, chains of near copies near the threshold, and passages in common."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", " \t\n", "one", "one", "ONE", "two words", "Two  words", "a b c d", "a b c d", "a b c d e", "x " * 500]
    for _ in range(groups):
        words = [word() for _ in range(rng.choice([6, 8, 20, 60, 150]))]
        if rng.random() < 0.5:
            words += passage.split()
        for _ in range(rng.choice([1, 2, 5])):
            texts.append(" ".join(words))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = word()
    base = [word() for _ in range(80)]
    for _ in range(60):
        near = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            near[rng.randrange(len(near))] = word()
        texts.append(" ".join(near))
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", 7) for i, t in rows], "doc_id long, text string, n string, node int")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    assert sorted(map(tuple, jj.near_duplicates(frame(spark, rows)).collect())) == brute(rows)


@pytest.mark.parametrize("crowd", [0, 4, 10**9])
def test_with_large_paths_forced(spark, monkeypatch, crowd):
    monkeypatch.setattr(jj, "CHUNK", 3)
    monkeypatch.setattr(jj, "BLOCK", 20)
    monkeypatch.setattr(jj, "CROWD", crowd)
    monkeypatch.setattr("burnish.llm.common.SMALL_ROWS", 5)
    monkeypatch.setattr("burnish.llm.common.is_small.__defaults__", (5,), raising=False)
    monkeypatch.setattr("burnish.llm.common.HOT_ROWS", 10)
    rows = corpus(4, groups=10)
    assert sorted(map(tuple, jj.near_duplicates(frame(spark, rows)).collect())) == brute(rows)


def test_prefix_choice_keeps_the_bound():
    import numpy as np

    for n in range(1, 60):
        take, k = jj.choose(n, np.full(n, 5))
        assert take == n - jj.least_overlap(n) + k <= n
    assert jj.choose(100, np.full(10, 9))[0] == 0


def test_keep_one_keeps_columns_and_the_smallest_id(spark):
    rows = [(4, "a b c d e f g"), (2, "a b c d e f g"), (9, "other"), (5, None), (6, None)]
    out = jj.keep_one(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "n", "node"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 5, 6, 9]


def test_keep_one_keeps_one_row_of_null_and_repeated_ids(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, near + " one"), (7, near), (7, near), (3, "all by itself"), (3, near + " two"), (None, "b c d e f g"), (None, "b c d e f g"), (None, None)]
    got = sorted(((r.doc_id, r.text) for r in jj.keep_one(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(3, near + " two"), (3, "all by itself"), (None, "b c d e f g"), (None, None)], key=repr)


def test_empty_table_and_null_ids(spark):
    assert jj.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, None), (3, "a b c d e f")]
    got = sorted(map(tuple, jj.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (None, 0, None), (3, 2, 3)], key=repr)


def test_no_links_are_told_without_python(spark):
    prefix = spark.range(3).selectExpr("id AS shingle", "id AS node", "6L AS n", "1L AS k", "true AS head", "0 AS middle")
    labels, sets = spark.range(0).selectExpr("id AS node", "id AS label"), spark.range(3).selectExpr("id AS node", "6L AS n", "array(id) AS shingles")
    none = jj.cross_links(prefix, labels, sets)
    assert "ExistingRDD" not in none._jdf.queryExecution().toString()
    assert none.dtypes == [("a", "bigint"), ("b", "bigint")] and none.collect() == []


def test_powers_do_not_outlive_the_task():
    import pyarrow as pa

    from burnish.llm import shingles

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c d e f g"])], ["doc_id", "text"])
    assert len(list(jj._sets(iter([batch]), 5))) == 1
    assert shingles._powers.cache_info().currsize == 0
