"""Steps on streams that need more than the row at hand: earlier rows, and tables that change meanwhile."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from burnish.errors import CleaningError, need_column
from burnish.functions.numbers import present
from burnish.operators.joining import lookup
from burnish.operators.ordered import need_order
from burnish.operators.rows import drop_duplicates
from burnish.operators.stats import Need
from burnish.plans.runner import Step, run_plan

Tables = Callable[[SparkSession], Mapping[str, DataFrame]]

#: the number of the micro-batch, by which the result is partitioned
BATCH = "batch"
_KEY, _SEEN, _TIME = "__key", "__seen", "__event_time"


def distinct_within(stream: DataFrame, subset: Sequence[str], time_column: str, delay: str) -> DataFrame:
    """The first row of each key that a stream brings, for keys that repeat within ``delay`` of one another.

    The state of a key goes when the watermark is ``delay`` past it, so it is as large as the keys of that time.
    """
    need_column(stream, time_column, *subset)
    if not subset:
        raise CleaningError("the columns of the key are missing")
    if isinstance(stream.schema[time_column].dataType, T.TimestampType):
        return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(list(subset))
    # A watermark needs an instant; times without a zone are taken as of the session's.
    timed = stream.withColumn(_TIME, F.col(f"`{time_column}`").cast("timestamp"))
    return timed.withWatermark(_TIME, delay).dropDuplicatesWithinWatermark(list(subset)).drop(_TIME)


def write_batches(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    steps: Sequence[Step] = (),
    tables: Tables | None = None,
    distinct: Sequence[str] = (),
    order_by: Sequence[str] | None = None,
    stats: Mapping[Need, object] | None = None,
) -> DataStreamWriter:
    """Clean each micro-batch as a table and write it to its own partition of ``path``; to be started by the caller.

    ``tables`` is called for every micro-batch, so keys meet the parents there are by then. ``distinct`` names columns of
    the result of which a row already written, in whichever earlier micro-batch, lets no other through; within
    a micro-batch the first in ``order_by`` is kept. A step that fails ends the stream. A micro-batch that
    is repeated after a failure replaces what it wrote, and only looks at the micro-batches before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = run_plan(batch, steps, tables=tables(spark) if tables else None, order_by=order_by, stats=stats)
        failed = [r.message for r in done.records if not r.success]
        if failed:
            raise CleaningError(failed[0])
        rows = done.df
        if BATCH in rows.columns:
            raise CleaningError(f"column {BATCH!r} would clash with the number of the micro-batch")
        if distinct:
            rows = _unseen(drop_duplicates(rows, list(distinct), "first", list(order_by)), distinct, path, number)
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    if distinct:
        need_order(stream, order_by, "keeping the first row of a key")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _unseen(rows: DataFrame, key: Sequence[str], path: str, number: int) -> DataFrame:
    """The rows whose key no earlier micro-batch has written. Only the key's columns of those are read."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    earlier = [
        str(f.getPath().toString())
        for f in (system.listStatus(folder) if system.exists(folder) else [])
        if f.getPath().getName().startswith(f"{BATCH}=") and int(f.getPath().getName().split("=")[1]) < number
    ]
    if not earlier:
        return rows
    # Null keys are equal to each other, so keys are compared by a digest of what they hold.
    digest = F.sha2(F.to_json(F.struct(*[present(rows, c).alias(c) for c in key]), {"ignoreNullFields": "false"}), 256)
    written = spark.read.schema(rows.select(*[F.col(f"`{c}`") for c in key]).schema).parquet(*earlier)
    seen = written.select(digest.alias(_SEEN))
    return lookup(rows.withColumn(_KEY, digest), seen, _KEY, _SEEN, "left_anti").drop(_KEY)
