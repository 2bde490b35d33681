"""What the operators of this subpackage share: reading, sizes that decide how to join, and names that never clash."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.operators.scratch import settle

#: A side of at most so many narrow rows (an id or digest and a few numbers) is broadcast: some 20 MB.
SMALL_ROWS = 200_000
#: A group holding at least this many rows, and a millionth of all, counts as hot: there are a million of them at most.
HOT_ROWS = 10_000

#: Bytes of rows that go to a Python worker at once (or one row): long texts count, not rows.
BATCH_BYTES = 8 << 20
#: The same for work that takes texts in smaller portions anyway. The JVM's buffer for a batch grows to twice its size, is
#: copied as it grows, and what is freed stays with the allocator of the thread that asked for it.
SMALL_BATCH_BYTES = 2 << 20

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage, with the SQL to compare it with."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed, to break ties by."""
    return F.xxhash64(*[col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must to know."""
    return df.select().limit(rows + 1).count() <= rows


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    bundle = f"{tempfile.mkdtemp(prefix='burnish-code-')}/{root.name}.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(bundle)
    _shipped.add(context.applicationId)


def in_python(df: DataFrame, work: Callable, schema: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, which get some ``batch_bytes`` of rows at a time."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers wait for further tasks with what they hold."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with the one row per ``key`` in ``groups``, whose column ``size`` counts the rows of the key.

    Few groups are broadcast. Otherwise the hot ones are (at most a million, as each holds a millionth of all rows),
    so that their rows stay where they are, and only rows of other keys are shuffled. Null keys match nothing.
    Both sides are read several times: pass tables, not long plans.
    """
    if is_small(groups):
        return rows.join(F.broadcast(groups), key, "left")
    hot = F.col(size) >= max(HOT_ROWS, total // 1_000_000)
    met = rows.join(F.broadcast(groups.where(hot)), key, "left")
    rest = met.where(F.col(size).isNull()).select(*rows.columns)
    return met.where(F.col(size).isNotNull()).unionByName(rest.join(groups.where(~hot), key, "left"))


def without(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in the single column of ``dropped``; all columns, in order.

    Rows with a null id stay. ``dropped`` is broadcast if it is small, and shuffled otherwise.
    """
    mark = fresh(docs, "dropped_id")
    dropped = dropped.select(F.col(dropped.columns[0]).alias(mark))
    side = F.broadcast(dropped) if is_small(dropped) else dropped
    return docs.join(side, col(id_col) == F.col(mark), "left_anti")


__all__ = ["attach", "col", "fresh", "in_python", "is_small", "query", "release_memory", "row_hash", "settle", "ship", "table", "without"]
