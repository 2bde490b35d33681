"""Nearest neighbours by randomly rotated one-bit codes, with error bounds that say which vectors to rerank.

A vector is taken relative to the mean of all, scaled to length one and rotated at random; its code is the signs of the
components, packed to bits. With two scalars per vector, its distance to the mean and the inner product of the vector
with its code, the inner product with a query is estimated without bias from the code alone, and lies within a known
distance of the estimate with a probability that does not depend on the data. Per block of the index and query, the
vectors whose distance may, by its lower bound, be among the nearest ``k`` by their upper bounds are measured exactly
in double precision; the best ``k`` go on, and are merged over all blocks.

The index is a table of blocks of ``BLOCK`` vectors, written to the shared folder; queries come in blocks of
``QUERIES``. Both are dealt to shards of a bounded size, every query block to all of them, so that no task holds more
than some blocks. All codes are scanned: no cell is left out, since embeddings without clusters would lose neighbours.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without
an id or of another length than most vectors have (of equally frequent lengths, the largest). A query whose vector
takes no part has no neighbours. Rows that share an id are candidates each; as queries, the smallest vector of an id
counts, and no row of its id is its neighbour. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from burnish.llm.common import col, in_python, query, settle, table

BLOCK = 4096
QUERIES = 256
#: Index blocks per shard.
SHARD = 8
NEAREST = 10
#: Standard deviations of the estimate that the bounds allow for; 1.9 fails about once in 30 vectors on one side.
CERTAINTY = 3.0
SEED = 11

INDEX = "shard long, ids binary, codes binary, radii binary, fits binary, vectors binary"


@lru_cache(maxsize=4)
def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, vector of doubles) that take part, before their length is looked at."""
    vector = col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    some = F.exists("vector", lambda x: x != 0)
    return rows.select(col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & finite & some)


def dimensions_of(rows: DataFrame) -> int:
    found = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def mean_of(rows: DataFrame, dimensions: int) -> np.ndarray:
    """The mean of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dimensions), 0
        for batch in batches:
            total += _matrix(batch, dimensions).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(dimensions), -1], pa.int32()), pa.array([*total, n], pa.float64())], ["at", "total"])

    summed = {r["at"]: r["total"] for r in in_python(rows, run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()}
    return np.array([summed[i] for i in range(dimensions)]) / max(1.0, summed[-1])


def encode(vectors: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, distances to the mean, and inner products of the unit vectors with their codes."""
    offset = vectors - mean
    radii = np.sqrt((offset**2).sum(axis=1))
    rotated = (offset / np.maximum(radii, 1e-300)[:, None]) @ rotation(vectors.shape[1])
    codes = np.packbits(rotated > 0, axis=1)
    fits = np.abs(rotated).sum(axis=1) / np.sqrt(vectors.shape[1])
    return codes, radii, fits


def build_index(rows: DataFrame, dimensions: int, mean: np.ndarray, block: int = BLOCK, shards: int = 1) -> DataFrame:
    """One row per block of vectors (columns of INDEX)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        def packed(ids, vectors):
            codes, radii, fits = encode(vectors, mean)
            data = [x.tobytes() for x in (ids, codes, radii, fits, vectors)]
            columns = [pa.array([zlib.crc32(data[0]) % shards], pa.int64()), *(pa.array([x], pa.binary()) for x in data)]
            return pa.RecordBatch.from_arrays(columns, ["shard", "ids", "codes", "radii", "fits", "vectors"])

        ids, vectors = np.zeros(0, np.int64), np.zeros((0, dimensions))
        for batch in batches:
            ids = np.concatenate([ids, batch.column("vec_id").to_numpy()])
            vectors = np.concatenate([vectors, _matrix(batch, dimensions)])
            while len(ids) >= block:
                yield packed(ids[:block], np.ascontiguousarray(vectors[:block]))
                ids, vectors = ids[block:], vectors[block:]
        if len(ids):
            yield packed(ids, np.ascontiguousarray(vectors))

    return in_python(rows, run, INDEX)


def bounds(codes: np.ndarray, radii: np.ndarray, fits: np.ndarray, queries: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, queries by vectors."""
    d = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    offset = queries - mean
    q_radii = np.sqrt((offset**2).sum(axis=1))
    rotated = (offset / np.maximum(q_radii, 1e-300)[:, None]) @ rotation(d)
    fit = np.maximum(fits, 1e-9)
    inner = (rotated.astype(np.float32) @ signs.T) / np.sqrt(d) / fit
    error = CERTAINTY * np.sqrt(np.maximum(0.0, 1 - fits**2)) / fit / np.sqrt(max(1, d - 1)) + 1e-5
    base = radii**2 + (q_radii**2)[:, None]
    cross = 2 * q_radii[:, None] * radii
    return base - cross * np.minimum(1, inner + error), base - cross * np.maximum(-1, inner - error)


def search_block(ids, codes, radii, fits, vectors, query_ids, queries, mean, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its id, and ids and distances of at most ``k`` nearest vectors of the block."""
    low, high = bounds(codes, radii, fits, queries, mean)
    for i, own in enumerate(query_ids):
        others = ids != own
        reach = high[i][others]
        limit = np.partition(reach, k - 1)[k - 1] if len(reach) > k else np.inf
        at = np.flatnonzero((low[i] <= limit) & others)
        distance = np.sqrt(((vectors[at] - queries[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[at], distance))[:k]
        yield own, ids[at][best], distance[best]


def nearest(
    rows: DataFrame, is_query, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """Of the rows for which the column ``is_query`` (of vec_id) holds, the ``k`` nearest: query_id, rank, vec_id, score."""
    kept = settle(usable(rows, id_col, vector_col))
    d = dimensions_of(kept)
    kept = kept.where(F.size("vector") == d)
    n = kept.count()
    schema = "query_id long, vec_id long, score double"
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    mean = mean_of(kept, d)
    shards = max(1, n // (block * SHARD))
    index = settle(build_index(kept, d, mean, block, shards))
    asked = kept.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                part = batch.slice(a, QUERIES)
                ids, vectors = part.column("vec_id").to_numpy().tobytes(), np.ascontiguousarray(_matrix(part, d)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([vectors], pa.binary())], ["query_ids", "query_vectors"])

    blocks = settle(in_python(asked, pack, "query_ids binary, query_vectors binary"))
    dealt = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    pairs = index.join(dealt, "shard").drop("shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                raw = {name: batch.column(name)[r].as_buffer() for name in batch.schema.names}
                of = lambda name, kind, raw=raw: np.frombuffer(raw[name], kind)
                ids = of("ids", np.int64)
                found = list(
                    search_block(
                        ids, of("codes", np.uint8).reshape(len(ids), -1), of("radii", float), of("fits", float), of("vectors", float).reshape(-1, d),
                        of("query_ids", np.int64), of("query_vectors", float).reshape(-1, d), mean, k,
                    )
                )
                queries = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                columns = [queries.astype(np.int64), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    found = in_python(pairs, search, schema)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op3_nearest_neighbours")
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
