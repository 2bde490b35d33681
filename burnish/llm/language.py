"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

* Features: the 1- to 3-grams of the lower-cased text, hashed to ``BUCKETS`` places; ``log(1 + count)`` times the inverse
  document frequency, scaled to length one. Document frequencies count every learning document, in Spark.
* Fit: follow-the-regularised-leader with an elastic net (L1 keeps the weights sparse) on about ``SAMPLE`` learning
  documents at most, chosen by a hash, as many of each language. That is the bound of what reaches the driver: their
  features, never texts.
* Calibration: a temperature that minimises the log loss on a fifth of the sample, kept out of the fit.

Defined results: a text that is null or has no letter is ``und`` with score 0. Without learning rows everything is
``und``. A null id counts as the empty text where rows are divided. Rows may repeat; each is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.common import col, in_python, query, table

BUCKETS = 1 << 15
LONGEST = 3
#: Bound of the documents that the weights are fitted on; at least LEAST_PER_LANGUAGE of each are tried for.
SAMPLE = 4_000
LEAST_PER_LANGUAGE = 20
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
UNKNOWN = "und"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit(""))) % parts


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    places, total = [], np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(points) >= n:
            total = total[: len(points) - n + 1] + (points[n - 1 :] + np.uint64(n)) * _MULTIPLIERS[n - 1]
            mixed = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            places.append((mixed >> _SHIFT).astype(np.int64))
    return np.bincount(np.concatenate(places), minlength=BUCKETS) if places else np.zeros(BUCKETS, np.int64)


def weigh(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their weights, of length one."""
    found = counts(text)
    at = np.flatnonzero(found)
    values = np.log1p(found[at]) * idf[at]
    return at, values / (np.sqrt(values @ values) or 1.0)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    #: buckets with any weight, and their weights, one column a language
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        at, values = weigh(text, self.idf)
        p = softmax((values @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(learning: DataFrame) -> tuple[np.ndarray, int]:
    """Per bucket the number of learning documents that have it; and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen += counts(text.as_py()) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*seen[at], n], pa.int64())], ["bucket", "n"])

    rows = in_python(learning.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(rows["bucket"], rows["n"], strict=True))
    n = int(found.pop(-1, 0))
    out = np.zeros(BUCKETS)
    out[list(found.keys())] = list(found.values())
    return out, n


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of multinomial logistic regression by follow-the-regularised-leader, proximal with elastic net."""
    z, n = np.zeros((BUCKETS + 1, languages)), np.zeros((BUCKETS + 1, languages))
    order = np.random.default_rng(7)

    def at_present(at):
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, values, label = rows[i]
            at, values = np.append(at, BUCKETS), np.append(values, 1.0)
            w = at_present(at)
            p = softmax(values @ w)
            p[label] -= 1.0
            gradient = values[:, None] * p
            step = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - step * w
            n[at] += gradient**2
    final = at_present(np.arange(BUCKETS + 1))
    return final[:-1], final[-1]


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the smallest log loss, from a finer and finer grid."""
    low, high = np.log(0.02), np.log(20.0)
    for _ in range(6):
        grid = np.linspace(low, high, 9)
        losses = [-np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
        best = int(np.argmin(losses))
        low, high = grid[max(0, best - 1)], grid[min(8, best + 1)]
    return float(np.exp((low + high) / 2))


def train(learning: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on rows (doc_id, text, lang) without nulls in text and lang."""
    learning = learning.where(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in learning.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    frequency, n = document_frequencies(learning)
    idf = np.log((1 + n) / (1 + frequency)) + 1.0
    each = max(LEAST_PER_LANGUAGE, sample // len(languages))
    share = F.lit(0.0)
    for name, size in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, each / size))).otherwise(share)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [weigh(t.as_py(), idf) for t in batch.column("text")]
            at = pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32()))
            values = pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("u"), at, values], ["lang", "u", "at", "values"])

    drawn = learning.withColumn("u", u).where(F.col("u") < share).select("text", "lang", "u")
    found = in_python(drawn, features, "lang string, u double, at array<int>, values array<float>").toPandas().sort_values("u")
    number = {name: i for i, name in enumerate(languages)}
    rows = [(np.asarray(a), np.asarray(v, float), number[name]) for name, a, v in zip(found["lang"], found["at"], found["values"], strict=True)]
    held = rows[::5] if len(rows) >= 10 else rows
    weights, bias = fit_ftrl([r for i, r in enumerate(rows) if i % 5] if len(rows) >= 10 else rows, len(languages))
    logits = np.array([v @ weights[at] + bias for at, v, _ in held])
    return Model(languages, idf, weights, bias, temperature_of(logits, np.array([r[2] for r in held])))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            languages, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), languages, scores], ["doc_id", "lang_pred", "score"])

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return in_python(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def learning_rows(docs: DataFrame) -> DataFrame:
    """The documents that may be learnt from: all but a quarter by their id, with text and language."""
    return docs.where((remainder("doc_id", 4) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(learning_rows(docs)))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
