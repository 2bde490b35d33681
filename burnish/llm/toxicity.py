"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Text is cut into clauses. A first transducer, an Aho-Corasick automaton over word beginnings, rewrites words as symbols
with weights: insult, threat. It is composed with clause transducers that read the symbols from left to right:

* negation opens a scope of a few words, in which a match counts as denied;
* reported speech (a verb of saying before the match in its clause) makes the rest of the clause reported;
* a target (a word of the second person) makes a match directed; of threats without one a quarter counts.

Each match leaves the machine with its weight on one of the tapes asserted, directed, denied, reported, threat. The sums
of the tapes over a document, and its strongest clause, are the features of a logistic regression, whose weights say how
much a denied or reported insult still counts.

Learning: insults of any language are word beginnings (``STEM`` letters or more, or whole words) that are asserted, not
denied or reported, likelier in toxic documents than in others. Of copies one text is learnt from, however many there
are. All learning texts are counted, in Spark. Whatever has
evidence against the general rate is a candidate, however weak. Then stems are chosen one by one while the toxic
documents that hold them are more than all chosen so far explain (from at most ``COVER_ROWS`` documents of each kind, as
lists of candidate numbers), so that words that merely stand beside an insult, as in many copies of one document, are
not learnt. A stem's weight is its slope beside the others', and the weights of several in a clause add up. The
regression is fitted on the features of at most ``FIT_ROWS`` texts, chosen by a hash. Given words (``INSULTS``,
``THREATS``) count from the start. Threats are these English words only: labels do not tell them from insults, so what
is learnt of threats enters as stems of insults. Third-person insults are asserted, not directed.

Defined results: null and empty texts have no match and get the score of the intercept. Null labels are not learnt
from; labels that disagree on a text (in copies, or as its id is labelled twice) count once each. Without learning rows of both kinds the
given words decide with fixed weights. A null id has no label.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.common import SMALL_BATCH_BYTES, col, fresh, in_python, is_small, query, settle, table
from burnish.llm.language import remainder

INSULTS = ("idiot", "moron", "imbecile", "scum", "loser", "stupid", "worthless", "pathetic", "disgusting", "trash", "clown", "dumb")
THREATS = ("kill", "murder", "strangle", "stab", "destroy", "hurt")
TARGETS = frozenset("you your you're youre u du dich dir ihr tu te toi vous usted eres".split())
NEGATIONS = frozenset("not no never neither nor isn't aren't don't doesn't wasn't cannot nicht kein keine nie pas jamais nunca".split())
REPORTS = frozenset("said says told claimed claims wrote called reported quoted alleged sagte dit dijo".split())
MARKS = NEGATIONS | REPORTS
#: Words after a negation that it covers.
SCOPE = 3

STEM, LONGEST_STEM = 4, 8
#: A candidate occurs in this share of the toxic learning documents, in two at least.
LEAST_SHARE = 0.004
#: Nats of evidence that a stem needs beyond the logarithm of the number of candidates, or chance would find some.
DOUBT = 5.0
COVER_ROWS = 4_000
FIT_ROWS = 20_000
THRESHOLD = 0.7

_CLAUSE = re.compile(r"[.!?;:\n\r]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
TAPES = ("asserted", "directed", "denied", "reported", "threat", "strongest", "any")


def asserted_words(text: str) -> set[str]:
    """The words of a lower-case text that are neither denied nor reported."""
    out: set[str] = set()
    for clause in _CLAUSE.split(text):
        words = _WORD.findall(clause)
        if MARKS.isdisjoint(words):
            out.update(words)
            continue
        scope = 0
        for word in words:
            if scope <= 0:
                out.add(word)
            scope = SCOPE if word in NEGATIONS else scope - 1
            if word in REPORTS:
                break
    return out


def stem_counts(text: str) -> Counter[str]:
    """Beginnings of the asserted words of a text, and the words themselves behind a full stop, for which no beginning
    stands, each with the number of different words that have it."""
    out: Counter[str] = Counter()
    for word in asserted_words(text.lower()):
        if len(word) >= 3:
            out[word + "."] += 1
            for n in range(STEM, min(len(word), LONGEST_STEM) + 1):
                out[word[:n]] += 1
    return out


@dataclass
class Grammar:
    """Weighted stems (a full stop at the end: the whole word), threats, and the weights of the tapes."""

    stems: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=dict)
    intercept: float = -3.0
    tapes: tuple[float, ...] = (2.5, 2.5, 0.2, 0.5, 3.0, 1.0, 3.0)

    @cached_property
    def words(self):
        """The transducer from letters to weighted symbols."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for kind, entries in (("insult", self.stems), ("threat", self.threats)):
            for stem, weight in entries.items():
                automaton.add_word(stem.removesuffix("."), (stem.removesuffix("."), stem.endswith("."), kind, weight))
        automaton.make_automaton()
        return automaton

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def symbols(self, text: str) -> dict[int, tuple[str, float]]:
        """Starts of the words that are insults or threats, each with its kind and largest weight."""
        found: dict[int, tuple[str, float]] = {}
        if not len(self.words):
            return found
        for end, (stem, whole, kind, weight) in self.words.iter(text):
            start = end - len(stem) + 1
            if (start == 0 or not _letter(text[start - 1])) and not (whole and end + 1 < len(text) and _letter(text[end + 1])):
                if start not in found or found[start][1] < weight:
                    found[start] = (kind, weight)
        return found

    def features(self, text: str | None) -> list[float]:
        """The sums of the tapes."""
        lowered = (text or "").lower()
        symbols = self.symbols(lowered)
        tapes = dict.fromkeys(TAPES, 0.0)
        for begin, end in clauses_at(lowered, sorted(symbols)):
            strength = self.read_clause(lowered, begin, end, symbols, tapes)
            tapes["strongest"] = max(tapes["strongest"], strength)
        tapes["any"] = min(1.0, tapes["asserted"] + tapes["directed"] + tapes["threat"])
        return [math.log1p(tapes[t]) for t in TAPES]

    def read_clause(self, text: str, begin: int, end: int, symbols: dict, tapes: dict[str, float]) -> float:
        """Run the clause transducers over one clause; returns the weight of what it asserts."""
        words = [(m.start(), m[0]) for m in _WORD.finditer(text, begin, end)]
        directed = any(word in TARGETS for _, word in words)
        scope, reported, total = 0, False, 0.0
        for start, word in words:
            if start in symbols:
                kind, weight = symbols[start]
                if scope > 0:
                    tapes["denied"] += weight
                elif reported:
                    tapes["reported"] += weight
                elif kind == "threat":
                    tapes["threat"] += weight if directed else weight / 4
                    total += weight if directed else 0.0
                else:
                    tapes["directed" if directed else "asserted"] += weight
                    total += weight
            scope = SCOPE if word in NEGATIONS else scope - 1
            reported = reported or word in REPORTS
        return total

    def score(self, features: list[float]) -> float:
        z = self.intercept + sum(w * x for w, x in zip(self.tapes, features, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _letter(c: str) -> bool:
    return c.isalpha()


def clauses_at(text: str, places: list[int]) -> Iterator[tuple[int, int]]:
    """The clauses that hold any of the places, each once."""
    begin, k = 0, 0
    if not places:
        return
    for mark in _CLAUSE.finditer(text):
        if places[k] < mark.start():
            yield begin, mark.start()
            while k < len(places) and places[k] < mark.start():
                k += 1
            if k == len(places):
                return
        begin = mark.end()
    yield begin, len(text)


def given() -> Grammar:
    """The grammar before anything is learnt."""
    return Grammar({w: 1.0 for w in INSULTS}, {w + ".": 1.0 for w in THREATS})


def _count_stems(rows: DataFrame, among: set[str] | None) -> DataFrame:
    """Per stem the number of documents that have it; only those in ``among``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found = stem_counts(text.as_py()).keys()
                seen.update(found if among is None else found & among)
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["stem", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["stem", "n"])

    return in_python(rows.select("text"), run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def _draw(rows: DataFrame, count: int, most: int, key: Column) -> DataFrame:
    """At most ``most`` of ``count`` different rows: chance draws six deviations fewer, so that it never exceeds them."""
    if count <= most:
        return rows
    share = max(1.0, most - 6 * math.sqrt(most)) / count
    return rows.where(F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(share))


def _choose(toxic: DataFrame, clean: DataFrame, sizes: dict[int, int], names: list[str], least: float) -> dict[str, float]:
    """Stems that explain which documents are toxic beside each other, from a bounded sample of both kinds.

    Their weights are parts of the largest slope, which may be that of the given words.
    """
    known = given()
    number = {s: i + 1 for i, s in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            held = [[0] * (known.score(known.features(t)) > 0.5) + [number[s] for s, n in stem_counts(t).items() if s in number for _ in range(n)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.int32()))], ["stems"])

    held: list[list[int]] = []
    labels: list[float] = []
    for label, rows in ((1, toxic), (0, clean)):
        drawn = _draw(rows, sizes[label], COVER_ROWS, F.xxhash64("text"))
        held += [r["stems"] for r in in_python(drawn.select("text"), run, "stems array<int>").collect()]
        labels += [float(label)] * (len(held) - len(labels))
    slopes = forward_slopes(held, labels, len(names) + 1, least)
    top = max(slopes.values(), default=1.0)
    return {names[s - 1]: w / top for s, w in slopes.items() if s}


def forward_slopes(held: list[list[int]], labels: list[float], count: int, least: float) -> dict[int, float]:
    """Slopes (all positive) of a logistic regression over how often marks are held.

    Mark 0 takes part from the start. Others enter, the one with most evidence first, while a mark makes the labels
    likelier by ``least`` nats than the marks that have entered do without it.
    """
    if not held:
        return {}
    y = np.array(labels)
    pairs = Counter((s, r) for r, h in enumerate(held) for s in h)
    keys = sorted(pairs)
    mark, row = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    often = np.array([pairs[k] for k in keys], float)
    ends = np.searchsorted(mark, np.arange(count + 1))
    rate = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    z = np.full(len(y), math.log(rate / (1 - rate)))
    slopes: dict[int, float] = {0: 0.0} if ends[1] else {}
    chance = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def refit() -> None:
        for _ in range(5):
            p = chance(z)
            z[:] += max(-1.0, min(1.0, float((y - p).sum()) / (float((p * (1 - p)).sum()) + 1e-6)))
            for s in slopes:
                at, x = row[ends[s] : ends[s + 1]], often[ends[s] : ends[s + 1]]
                p = chance(z[at])
                step = (float((x * (y[at] - p)).sum()) - 0.1 * slopes[s]) / (float((x * x * p * (1 - p)).sum()) + 0.1)
                step = max(-slopes[s], -1.0, min(1.0, step))
                z[at] += step * x
                slopes[s] += step

    def evidence() -> np.ndarray:
        base, label, slope = z[row], y[row], np.zeros(count)
        for _ in range(8):
            p = chance(base + slope[mark] * often)
            up, bend = np.bincount(mark, often * (label - p), count), np.bincount(mark, often**2 * p * (1 - p), count)
            slope = np.clip(slope + np.clip((up - 0.1 * slope) / (bend + 0.1), -1, 1), 0, 20)
        old, new = chance(base), chance(base + slope[mark] * often)
        return np.bincount(mark, np.log(np.where(label == 1, new / old, (1 - new) / (1 - old))), count)

    refit()
    while len(slopes) < count:
        gains = evidence()
        gains[[0, *slopes]] = 0
        best = int(np.argmax(gains))
        if not gains[best] >= least:
            break
        slopes[best] = 0.0
        refit()
    return {s: w for s, w in slopes.items() if w > 0}


def likelihood_gain(toxic: int, clean: int, rate: float) -> float:
    """By how much (in nats) the label of documents with a stem is likelier under their own rate than under the general one."""
    n = toxic + clean
    part = lambda k, p: k * math.log((k / n) / p) if k else 0.0
    return part(toxic, rate) + part(clean, 1 - rate) if toxic > n * rate else 0.0


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Intercept and weights by Newton's method."""
    scale = np.maximum(x.max(axis=0), 1e-9)
    a = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:] / scale


def train(labelled: DataFrame) -> Grammar:
    """Learn from rows (text, toxic), toxic being 0 or 1. Each different text counts once for each of its labels."""
    rows = labelled.where("toxic IN (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    rows = settle(rows.groupBy("text", "toxic").agg(F.count(F.lit(1)).alias("copies")).drop("copies"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return given()
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")
    least = max(2, math.ceil(LEAST_SHARE * sizes[1]))
    seen = {r["stem"]: r["n"] for r in _count_stems(toxic, None).where(F.col("n") >= least).toLocalIterator()}
    elsewhere = {r["stem"]: r["n"] for r in _count_stems(clean, set(seen)).toLocalIterator()}
    rate, sure = sizes[1] / (sizes[0] + sizes[1]), math.log(max(1, len(seen))) + DOUBT
    candidates = sorted((s for s in seen if likelihood_gain(seen[s], elsewhere.get(s, 0), rate) >= sure), key=lambda s: (-len(s), s))
    grammar = given()
    grammar.stems |= _choose(toxic, clean, sizes, candidates, sure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([grammar.features(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), found], ["toxic", "x"])

    drawn = _draw(rows, sizes[0] + sizes[1], FIT_ROWS, F.xxhash64("text", "toxic", F.lit(3)))
    fitted = in_python(drawn.select("toxic", "text"), run, "toxic int, x array<double>").toPandas()
    if fitted["toxic"].nunique() == 2:
        grammar.intercept, weights = fit_logistic(np.stack(fitted["x"]), fitted["toxic"].to_numpy(float))
        grammar.tapes = tuple(float(w) for w in weights)
    return grammar


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score, and the tapes' sums as ``tapes``."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.features(t.as_py()) for t in batch.column("text")]
            scores = pa.array([shared.value.score(x) for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores, pa.array(found, pa.list_(pa.float64()))], ["doc_id", "score", "tapes"])

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return in_python(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, tapes array<double>")


def keep_civil(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that score THRESHOLD or more; all columns as they were.

    Python is sent texts and gives back the rejected ones' ids; the documents themselves stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = [shared.value.score(shared.value.features(t.as_py())) >= THRESHOLD for t in batch.column("text")]
            yield batch.select(["doc_id", "text_key"]).filter(pa.array(toxic, pa.bool_()))

    lost, key = fresh(docs, "lost_id"), fresh(docs, "lost_key")
    of_text = F.xxhash64(col(text_col).cast("string"))
    rows = docs.select(col(id_col).alias("doc_id"), of_text.alias("text_key"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rejected = settle(in_python(rows, run, f"doc_id {kind}, text_key long", SMALL_BATCH_BYTES).select(F.col("doc_id").alias(lost), F.col("text_key").alias(key)))
    side = F.broadcast(rejected) if is_small(rejected) else rejected
    return docs.join(side, col(id_col).eqNullSafe(F.col(lost)) & (of_text == F.col(key)), "left_anti")


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with their labels, of all documents but a third by their id."""
    mark = fresh(docs, "labelled_id")
    known = labels.where((remainder("doc_id", 3) != 1) & F.col("toxic").isNotNull()).select(F.col("doc_id").alias(mark), "toxic")
    side = F.broadcast(known) if is_small(known) else known
    texts = docs.where(remainder("doc_id", 3) != 1).select("doc_id", "text")
    return texts.join(side, F.col("doc_id") == F.col(mark)).select("text", "toxic")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = train(learning_rows(docs, table(spark, sf_dir, "labels")))
    found = score(docs, grammar)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
