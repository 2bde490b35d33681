"""Intermediate results in the shared checkpoint folder, so that a lost executor loses no work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: the one set for checkpoints, else a part of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_by_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_context.isDefined():
        return set_by_context.get()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/burnish-scratch"


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has written to yet, deleted when the session's JVM ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/burnish-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """``df``, written once if a shuffle precedes it: for operators that read it several times."""
    return settle(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so that later passes start from columnar files.

    Unlike a cached result it outlives its executors, and a pass over one column reads only that column.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
