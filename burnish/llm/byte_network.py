"""Quality by a convolutional network over bytes, in numpy.

A text is read as UTF-8 bytes. Each byte is looked up as ``DEPTH`` numbers; ``FILTERS`` learned filters look at every
window of ``WIDTH`` bytes. Their answers are max-pooled in cells of ``CELL`` windows and then in chunks of
``CELLS_PER_CHUNK`` cells, which overlap by one cell and cover the whole text however long it is. The mean and the
largest of a filter's answers over the chunks are combined by a logistic layer into one probability.

Fit: by Adam on at most ``FIT_TEXTS`` different learning texts of each label and ``FIT_BYTES`` of both together, of up to
``LONGEST_FIT`` bytes each, chosen by a hash; that is the bound of what reaches the driver. Texts are weighed by how many of their label they stand for, so
probabilities fit the labels' shares. Of copies one text is learnt from. Texts are looked up by narrow rows: only those
chosen move.

Defined results: null and empty texts are one zero byte. Null labels, and labels other than 0 and 1, are not learnt from;
labels that disagree on a text count once each. A null id has no label. Without learning texts of both labels all scores
are the share of label 1, and a half if there are none. Rows may repeat; each is scored. Scores are rounded to six
decimals, as the last digits of sums depend on which texts are read together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.common import col, in_python, query, settle, table
from burnish.llm.language import remainder

WIDTH, DEPTH, FILTERS = 8, 8, 32
#: Windows of a cell, cells of a chunk, and by how many cells chunks follow each other.
CELL, CELLS_PER_CHUNK, STEP = 64, 8, 7
#: Bounds of what the network is fitted on.
FIT_TEXTS, FIT_BYTES, LONGEST_FIT = 1_000, 5 << 20, 1 << 16
EPOCHS, LEAST_STEPS, BATCH, RATE = 14, 400, 24, 0.006
#: Windows read together; a multiple of CELL. And how many of them are multiplied at once, to stay in the cache.
PORTION, BLOCK = 1 << 18, 1 << 13
THRESHOLD = 0.5


@dataclass
class Portion:
    """Parts of texts laid out in cells: their bytes, which windows start in a text, and what is in each cell."""

    data: np.ndarray
    valid: np.ndarray
    #: the cells that hold any window, and the text of each
    held: np.ndarray
    text: np.ndarray


def portions(texts: Sequence[bytes], most: int = PORTION) -> Iterator[Portion]:
    """The texts in portions of about ``most`` windows; a longer text goes through several, cut between cells."""
    parts: list[tuple[int, bytes, int]] = []
    size = 0
    for i, text in enumerate(texts):
        text = text or b"\0"
        for start in range(0, len(text), most):
            windows = min(most, len(text) - start)
            if parts and size + windows > most:
                yield _laid_out(parts)
                parts, size = [], 0
            parts.append((i, text[start : start + windows + WIDTH - 1], windows))
            size += windows
    if parts:
        yield _laid_out(parts)


def _laid_out(parts: list[tuple[int, bytes, int]]) -> Portion:
    """Each part in cells of its own; its last windows see zeros behind it, or the next bytes of a text that was cut."""
    room = [-(-(windows + WIDTH - 1) // CELL) * CELL for _, _, windows in parts]
    data, valid, text, start = np.zeros(sum(room) + WIDTH, np.uint8), np.zeros(sum(room), bool), [], 0
    for (i, raw, windows), size in zip(parts, room, strict=True):
        data[start : start + len(raw)] = np.frombuffer(raw, np.uint8)
        valid[start : start + windows] = True
        text.append(np.full(size // CELL, i))
        start += size
    held = valid.reshape(-1, CELL).any(axis=1)
    return Portion(data, valid, held, np.concatenate(text)[held])


def chunks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of every chunk of texts with so many cells (the last one repeated where a chunk has fewer), and where
    the chunks of each text begin."""
    number = 1 + np.maximum(0, -(-(counts - CELLS_PER_CHUNK) // STEP))
    begin = np.cumsum(number) - number
    of = np.repeat(np.arange(len(counts)), number)
    first = (np.arange(len(of)) - begin[of]) * STEP
    inside = np.minimum(first[:, None] + np.arange(CELLS_PER_CHUNK), counts[of][:, None] - 1)
    return inside + (np.cumsum(counts) - counts)[of][:, None], begin


@dataclass
class Network:
    bytes: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    intercept: float
    #: the score of every text, where nothing could be learnt
    fixed: float | None = None

    def answers(self, portion: Portion) -> tuple[np.ndarray, np.ndarray]:
        """What the filters answer, per held cell and window, and the numbers that every window sees."""
        numbers = self.bytes[portion.data]
        n = len(portion.valid)
        seen = as_strided(numbers, (n, WIDTH * DEPTH), numbers.strides)
        out = np.empty((n, FILTERS), np.float32)
        for i in range(0, n, BLOCK):
            np.matmul(np.ascontiguousarray(seen[i : i + BLOCK]), self.filters, out=out[i : i + BLOCK])
        out += self.bias
        out[~portion.valid] = -np.inf
        return out.reshape(-1, CELL, FILTERS)[portion.held], seen

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        """The probability of label 1 per text."""
        if self.fixed is not None or not len(texts):
            return np.full(len(texts), self.fixed or 0.0)
        cells, owners = [], []
        for portion in portions(texts):
            cells.append(self.answers(portion)[0].max(axis=1))
            owners.append(portion.text)
        counts = np.bincount(np.concatenate(owners), minlength=len(texts))
        at, begin = chunks_of(counts)
        pooled = np.maximum(np.concatenate(cells)[at].max(axis=1), 0)
        features = np.hstack([np.add.reduceat(pooled, begin) / np.diff(begin, append=len(pooled))[:, None], np.maximum.reduceat(pooled, begin)])
        z = (features @ self.out + self.intercept).astype(float)
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)

    def gradients(self, texts: Sequence[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss by bytes, filters, bias, out and intercept. The texts fit into one portion."""
        (portion,) = portions(texts, 1 << 62)
        answers, seen = self.answers(portion)
        best = answers.argmax(axis=1)
        cells = np.take_along_axis(answers, best[:, None], axis=1)[:, 0]
        at, begin = chunks_of(np.bincount(portion.text, minlength=len(texts)))
        which = cells[at].argmax(axis=1)
        cell = np.take_along_axis(at[:, :, None], which[:, None], axis=1)[:, 0]
        every = np.arange(FILTERS)
        pooled = np.maximum(cells[cell, every], 0)
        number = np.diff(begin, append=len(pooled))
        of = np.repeat(np.arange(len(texts)), number)
        largest = np.maximum.reduceat(pooled, begin)
        features = np.hstack([np.add.reduceat(pooled, begin) / number[:, None], largest])
        z = np.clip(features @ self.out + self.intercept, -30, 30)
        dz = ((1 / (1 + np.exp(-z)) - labels) * weights).astype(np.float32)
        # Of equal largest answers the first one learns.
        top = pooled == largest[of]
        place = np.where(top, np.arange(len(pooled))[:, None], len(pooled))
        first = np.minimum.reduceat(place, begin)[of] == np.arange(len(pooled))[:, None]
        back = dz[of][:, None] * (self.out[:FILTERS] / number[of][:, None] + self.out[FILTERS:] * first) * (pooled > 0)
        window = np.flatnonzero(portion.held)[cell] * CELL + best[cell, every]
        chunk, filter_ = np.nonzero(back)
        value, window = back[chunk, filter_].astype(np.float32), window[chunk, filter_]
        grad_filters, grad_bytes = np.zeros_like(self.filters), np.zeros_like(self.bytes)
        for f in range(FILTERS):
            mine = filter_ == f
            grad_filters[:, f] = value[mine] @ seen[window[mine]]
        through = (value[:, None] * self.filters.T[filter_]).reshape(-1, WIDTH, DEPTH)
        letters = portion.data[window[:, None] + np.arange(WIDTH)].ravel()
        for d in range(DEPTH):
            grad_bytes[:, d] = np.bincount(letters, through[:, :, d].ravel(), minlength=256)
        return [grad_bytes, grad_filters, back.sum(axis=0, dtype=np.float32), features.T @ dz, dz.sum(keepdims=True)]


def fit(texts: Sequence[bytes], labels: np.ndarray, weights: np.ndarray) -> Network:
    """Train by Adam, in the order of a fixed random generator."""
    rng = np.random.default_rng(11)
    small = lambda *shape, scale: rng.normal(size=shape, scale=scale).astype(np.float32)
    share = float(np.clip((labels * weights).sum() / weights.sum(), 0.01, 0.99))
    parameters = [
        small(256, DEPTH, scale=0.5),
        small(WIDTH * DEPTH, FILTERS, scale=1 / np.sqrt(WIDTH * DEPTH)),
        np.zeros(FILTERS, np.float32),
        small(2 * FILTERS, scale=0.1),
        np.full(1, np.log(share / (1 - share)), np.float32),
    ]
    first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    step, weights = 0, weights / weights.mean()
    epochs = max(EPOCHS, LEAST_STEPS * BATCH // len(texts))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            found = Network(*parameters[:4], parameters[4][0]).gradients([texts[i] for i in some], labels[some], weights[some] / len(some))
            step += 1
            for p, g, m, v in zip(parameters, found, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Network(*parameters[:4], float(parameters[4][0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fit on the texts of ``docs`` whose ids have a label in ``labels`` (id, label)."""
    texts = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).where("id IS NOT NULL")
    narrow = texts.select("id", F.xxhash64("text").alias("key"), F.octet_length("text").alias("size"))
    marks = labels.where(col(label).isin(0, 1)).select(col(id_col).alias("id"), col(label).cast("int").alias("label"))
    known = settle(narrow.join(marks, "id").groupBy("key", "size", "label").agg(F.min("id").alias("id")))
    numbers = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(numbers) < 2:
        return _constant(float(next(iter(numbers), 0.5)))
    chosen: list[tuple] = []
    for kind in (0, 1):
        left = FIT_BYTES // 2
        for row in known.where(F.col("label") == kind).orderBy(F.xxhash64("key", F.lit(5)), "key").limit(FIT_TEXTS).collect():
            if row["size"] <= min(left, LONGEST_FIT):
                left -= row["size"]
                chosen.append((row["id"], row["key"], kind))
    spelled = f"id {texts.schema['id'].dataType.simpleString()}, key long, label int"
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, spelled))  # at most FIT_TEXTS rows of each label
    found = texts.withColumn("key", F.xxhash64("text")).join(wanted, ["id", "key"]).select("id", "key", "label", "text")
    rows = found.dropDuplicates(["id", "key", "label"]).orderBy("key", "label").collect()
    drawn = np.array([r["label"] for r in rows])
    if len(set(drawn)) < 2:  # no text of one label fits into the bound
        return _constant(numbers[1] / (numbers[0] + numbers[1]))
    stands_for = np.array([numbers[k] / max(1, (drawn == k).sum()) for k in (0, 1)])
    return fit([r["text"].encode() for r in rows], drawn.astype(np.float32), stands_for[drawn])


def _constant(share: float) -> Network:
    none = np.zeros((0, 0), np.float32)
    return Network(none, none, none, none, 0.0, share)


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(texts), pa.float64())], ["doc_id", "score"])

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return in_python(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


@query("op12_quality_network")
def op12_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learning = [df.where(remainder("doc_id", 3) != 1) for df in (docs, labels)]
    found = score(docs, train(*learning))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
