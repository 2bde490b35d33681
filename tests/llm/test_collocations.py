"""Collocations against a plain version: awkward texts, border failures, big numbers, and what the sample misses."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from burnish.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, key string"


def plain(rows, top, least):
    """The result of the definitions, phrase by phrase."""
    words, counts = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang or "und" if lang is None else lang] += len(w)
            for size in range(1, 6):
                counts["und" if lang is None else lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            longer = (q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * candidates[q] >= 100 * a for q in longer):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "k") for i, t, lang in rows], SCHEMA)


def same(spark, rows, top=50, least=5, share=2):
    got = c.collocations(frame(spark, rows).repartition(3), top, least, share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, top, least)


def prose(n, seed, vocabulary=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choices(words, [1 / (i + 1) for i in range(vocabulary)], k=rng.randrange(40))) for _ in range(n)]


AWKWARD = [None, "", " \t ", ".,;:!?", "A b\tC  d", "É a b c d e f", "a b.a b,a b;a b:a b!a b?a b\na b\x0ba b\x0ca b\ra b", "x" * 5000, "日本 語 日本 語", "a\x00b c\x85d", "a a a a a a a a"]


def test_awkward_texts(spark):
    rows = [(i % 7 if i % 5 else None, t, lang) for i, (t, lang) in enumerate((t, lang) for t in AWKWARD * 4 for lang in ("en", None, "und", ""))]
    same(spark, rows)


@pytest.mark.parametrize("share", [1, 2, 40])
def test_prose(spark, share):
    rows = [(i, t, "en" if i % 3 else "de") for i, t in enumerate(prose(150, 1))]
    same(spark, rows, share=share)


def test_ties_cover_and_top(spark):
    rows = [(i, "one two three four five six, p q, r s, t u, of the of the", "en") for i in range(6)]
    same(spark, rows, top=4)
    same(spark, rows, top=100)


def test_border_failures_are_expanded(spark, monkeypatch):
    """A sample that is never drawn proposes nothing, so every phrase longer than a word comes from the expansion."""
    passes = []
    count = c.count
    monkeypatch.setattr(c, "count", lambda *a: passes.append(1) or count(*a))
    monkeypatch.setattr(c, "propose", lambda texts, share, least: texts.selectExpr("CAST(0 AS LONG) AS key").where("false"))
    same(spark, [(i, t, "en") for i, t in enumerate(prose(60, 2, 5))], share=1)
    assert len(passes) == 2


def test_a_full_filter_only_counts_more(spark, monkeypatch):
    monkeypatch.setattr(c, "FILTER_WORDS", 2)
    same(spark, [(i, t, "en") for i, t in enumerate(prose(80, 3))])


def test_portions_of_any_size_give_the_same(spark, monkeypatch):
    rows = [(i, t, "en") for i, t in enumerate(prose(60, 4) + [". ".join(prose(200, 5))])]
    texts = [t.encode() for _, t, _ in rows]

    def counts():
        out = Counter()
        for portion, _ in c.read_portions(iter([c.pa.RecordBatch.from_pydict({"text": [t.decode() for t in texts], "lang": ["en"] * len(texts)})])):
            for size, firsts, keys, times in c.counted(portion, None, None):
                for phrase, n in zip(c.phrases(portion, firsts, size).to_pylist(), times, strict=True):
                    out[phrase] += int(n)
        return out

    whole = counts()
    monkeypatch.setattr(c, "PORTION", 300)
    monkeypatch.setattr(c, "CHUNK", 50)
    assert counts() == whole


def test_words_longer_than_a_chunk_hash_alike_everywhere(monkeypatch):
    monkeypatch.setattr(c, "CHUNK", 64)
    for text in (b"a " + b"x" * 100 + b" b " + b"x" * 100, b"x" * 100 + b" c"):
        p = c.read_portion([text], [0], np.zeros(1, np.uint64))
        long_ones = {int(h) for h, s, e in zip(p.hashes, p.starts, p.ends, strict=True) if e - s == 100}
        assert len(long_ones) == 1
        assert long_ones == {int(c.read_portion([b"x" * 100], [0], np.zeros(1, np.uint64)).hashes[0])}


def test_scores_beyond_64_bits(spark):
    big = 40_000_000_000_000
    found = spark.createDataFrame(
        [("en", None, 3 * big + 1), ("en", "a", big + 7), ("en", "b", big + 9), ("en", "a b", big + 3)], "lang string, phrase string, n long"
    )
    (row,) = c.score_phrases(found).collect()
    assert row.score == 1000 * (big + 3) * (3 * big + 1) // ((big + 7) * (big + 9))


def test_empty_table(spark):
    assert c.collocations(frame(spark, [(1, "a b", "en")]).where("false")).count() == 0
