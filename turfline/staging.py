"""Cutting lineage with tables in the folder that all executors share.

A staged table is written once and read back, so an executor lost later costs a
re-read and never a recomputation of the steps before it.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Row groups of staged tables: a writer holds one in memory.
ROW_GROUP_BYTES = 32 << 20
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PARTITIONS = "spark.sql.shuffle.partitions"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only a local session, whose executors live in this process, may go without one.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "/tmp/checkpoints"


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stage(df: DataFrame, label: str, free: bool = False, partitions: int = 0) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    The files go with unstage, at the latest when the session's file system closes. With `free` the shuffles
    that made them go as soon as they are written, not when the driver's memory is next collected. `partitions`
    are the least that Spark's own shuffles have on the way.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/turfline/{label}-{uuid.uuid4().hex}"
    before = {_FREE: spark.conf.get(_FREE, "false"), _PARTITIONS: spark.conf.get(_PARTITIONS)}
    during = {_FREE: "true" if free else before[_FREE], _PARTITIONS: str(max(partitions, int(before[_PARTITIONS])))}
    try:
        for k, v in during.items():
            spark.conf.set(k, v)
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files, at = _folder(spark, path)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def unstage(*tables: DataFrame) -> None:
    """Delete the files of staged tables; nothing that is still to be computed may need them."""
    for table in tables:
        files, at = _folder(table.sparkSession, table.staged_path)
        files.delete(at, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """At most `rows` rows in an Arrow batch: rows that hold texts or whole blocks must not meet by the thousand."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)
