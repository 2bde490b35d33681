"""The clause grammar, what it learns, and held-out results."""

from __future__ import annotations

import os

import pytest

from burnish.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


def tapes(text, grammar=None):
    raw = dict.fromkeys(tx.TAPES, 0.0)
    g = grammar or tx.given()
    lowered = text.lower()
    symbols = g.symbols(lowered)
    for begin, end in tx.clauses_at(lowered, sorted(symbols)):
        g.read_clause(lowered, begin, end, symbols, raw)
    return {k: v for k, v in raw.items() if v}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("You are an idiot.", {"directed": 1.0}),
        ("What an idiot!", {"asserted": 1.0}),
        ("you are not an idiot", {"denied": 1.0}),
        ("He said you are an idiot", {"reported": 1.0}),
        ("He said it. You idiot", {"directed": 1.0}),
        ("I will kill you", {"threat": 1.0}),
        ("kill the process", {"threat": 0.25}),
        ("skill and killer", {}),
        ("Idiots, morons; clowns", {"asserted": 3.0}),
        ("not one of them\nidiot", {"asserted": 1.0}),
        ("", {}),
    ],
)
def test_clauses(text, expected):
    assert tapes(text) == expected


def labelled(spark, rows):
    return spark.createDataFrame(rows, "text string, toxic int")


def test_learns_stems_but_not_their_company(spark):
    toxic = [(f"word{i} zorgab{i % 7} filler companion{i % 3}", 1) for i in range(120)] + [("copy of a text with zorgen in it", 1)] * 80
    clean = [(f"word{i} filler companion{i % 3} other{i}", 0) for i in range(400)] + [(None, 0), ("", 0), ("x", None)]
    grammar = tx.train(labelled(spark, toxic + clean))
    learnt = set(grammar.stems) - set(tx.INSULTS)
    assert learnt and all(s.startswith("zorg") for s in learnt)
    high, low = (grammar.score(grammar.features(t)) for t in ("a zorgaxy here", "a filler here"))
    assert high >= tx.THRESHOLD > 0.3 > low
    assert grammar.score(grammar.features(None)) == grammar.score(grammar.features("")) < 0.3


def test_weak_stems_add_up(spark):
    """Half of the documents that hold a word of the family are clean: one by chance, where toxic ones hold several."""
    ends = ["an", "eb", "ic", "od", "uf", "ag", "eh", "il"]
    toxic = [(f"word{i} {' and '.join('grolm' + ends[(i + k) % 8] for k in range(4))} filler", 1) for i in range(80)]
    clean = [(f"word{i} grolm{ends[i % 8]} filler", 0) for i in range(80)] + [(f"word{i} filler other{i}", 0) for i in range(500)]
    denied = [(f"word{i} is not brusk filler", 0) for i in range(100)] + [(f"word{i} is brusk filler", 1) for i in range(30)]
    grammar = tx.train(labelled(spark, toxic + clean + denied))
    several, one, free = (grammar.score(grammar.features(t)) for t in ("a grolmxa and grolmyb and grolmzc and grolmvd", "a grolmxa here", "a filler"))
    assert several >= tx.THRESHOLD > one >= free
    assert any(s.startswith("brus") for s in grammar.stems)
    assert max(len(s) for s in tx.stem_counts("he said brusk. never a grolman but a grolmeb") if s.startswith(("brus", "grol"))) == 8


def test_without_labels_of_both_kinds_the_given_words_decide(spark):
    for rows in ([], [("a", 1)], [("a", 0), (None, None)]):
        grammar = tx.train(labelled(spark, rows))
        assert grammar.score(grammar.features("you idiot")) > 0.5 > grammar.score(grammar.features("you friend"))


def test_scores_and_filter_keep_rows_and_columns(spark):
    rows = [(1, "you idiot, you moron", "a", 1.0), (2, None, "b", 2.0), (None, "fine", "c", 3.0), (2, "fine", "d", 4.0), (3, "ok " * 60_000, "e", 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tapes string, score double")
    out = tx.score(df, tx.given())
    assert out.columns == ["doc_id", "score", "tapes"] and out.count() == 5
    kept = tx.keep_civil(df, tx.given())
    assert kept.columns == df.columns and sorted(r.tapes for r in kept.collect()) == ["b", "c", "d", "e"]
    assert tx.keep_civil(df.where("doc_id > 9"), tx.given()).count() == 0


def test_copies_of_a_text_teach_no_more_than_the_text(spark, monkeypatch):
    rows = [(f"word{'abcdefghij'[i % 10]}{i} zorg{'abcdefg'[i % 7]}ug filler", 1) for i in range(60)] + [(f"word{i} filler other{i}", 0) for i in range(200)]
    copies = [("one text with qualfen in it", 1)] * 3000
    once, often = (tx.train(labelled(spark, rows + extra)) for extra in (copies[:1], copies))
    assert once.stems.keys() == often.stems.keys() and any(s.startswith("zorg") for s in often.stems)
    assert once.intercept == pytest.approx(often.intercept) and once.tapes == pytest.approx(often.tapes)
    drawn = []
    monkeypatch.setattr(tx, "FIT_ROWS", 100)
    monkeypatch.setattr(tx, "fit_logistic", lambda x, y: drawn.append(len(x)) or (0.0, [0.0] * x.shape[1]))
    tx.train(labelled(spark, rows + copies))
    assert 0 < drawn[0] <= 100


def test_slopes_of_forward_selection():
    held = [[1, 1, 1, 2]] * 40 + [[1, 2]] * 40 + [[2]] * 100 + [[0]] * 30
    slopes = tx.forward_slopes(held, [1.0] * 40 + [0.0] * 140 + [1.0] * 30, 3, 10.0)
    assert set(slopes) == {0, 1}
    assert tx.forward_slopes([], [], 3, 10.0) == tx.forward_slopes([[2]], [1.0], 3, 10.0) == {}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_results(spark):
    found = tx.op8_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] / (counts[1, 1] + counts[1, 0]) > 0.75
    assert counts[1, 1] / (counts[1, 1] + counts.get((0, 1), 0)) > 0.93


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_recall_of_insults_beyond_the_list(spark):
    found = tx.op8_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out AND toxic = 1")
    found = found.join(spark.read.parquet(f"{SF}/documents.parquet").where("lang <> 'en'").select("doc_id"), "doc_id")
    hits = {r.predicted: r["count"] for r in found.groupBy("predicted").count().collect()}
    assert hits[1] / (hits[1] + hits[0]) > 0.75
