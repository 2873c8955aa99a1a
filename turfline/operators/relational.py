"""Lookup joins, first/last-wins deduplication, upserts and ordered distinct sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import MISSING
from .places import with_place


def last_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per non-blank key: the last in `order`."""
    w = Window.partitionBy(key).orderBy(*order)
    usable = rows.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return usable.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lookup(facts: DataFrame, dimension: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Left join to a dimension made unique first, so the number of facts never changes.

    Spark broadcasts a dimension that is small enough by its own size estimate.
    """
    return facts.join(last_wins(dimension, key, order), key, "left")


def fill_missing(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns})


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Upsert by key: the first row in `order` (newest first) of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_positions(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return rows.where(F.col(value).isNotNull() & (F.trim(value) != "")).groupBy(value).agg(F.min(position).alias("first_position"))


def surrogate_ids(rows: DataFrame, value: str, position: str, name: str) -> DataFrame:
    """Ids from 1 in order of first appearance."""
    first = first_positions(rows, value, position)
    return with_place(first, [F.col("first_position"), F.col(value)], name).select(value, F.col(name).cast("int").alias(name))


def content_key(attributes: str, leave_out: list[str]) -> Column:
    """A digest of a map's non-blank entries but some, whatever their order."""
    kept = F.map_filter(attributes, lambda k, v: ~k.isin(*leave_out) & v.isNotNull() & (F.trim(v) != ""))
    return F.when(F.size(kept) > 0, F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), 256))


def dedup_rows(rows: DataFrame, attributes: str, position: str, leave_out: list[str]) -> DataFrame:
    """Order-preserving deduplication over everything but provenance; rows without content go."""
    keyed = rows.withColumn("_key", content_key(attributes, leave_out)).where("_key IS NOT NULL")
    w = Window.partitionBy("_key").orderBy(position)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over tasks for all cores, whatever their bytes: where few bytes make much work (a page to write and parse, rows to explode), files and shuffled blocks that are small tell nothing of it."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)


#: Fixed value: about so many rows go to a task of a large join, window or deduplication.
ROWS_A_TASK = 500_000


def is_dealt(spark: SparkSession, n: int) -> bool:
    """Whether n rows are more than ROWS_A_TASK in each of the tasks that run at once, or of the session's shuffle partitions if these are fewer."""
    return n > ROWS_A_TASK * min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows, n of them or about that, dealt by keys into tasks of ROWS_A_TASK for what goes by these keys next; unchanged if they are few (is_dealt).

    A task's sorts and hash tables then keep their size when the input grows, where Spark's own shuffles have a fixed
    number of partitions and join those with few bytes. A join takes the number over for its other side. A key's rows stay in one task.
    """
    spark = rows.sparkSession
    return rows.repartition(tasks_for(spark, n), *keys) if is_dealt(spark, n) else rows


def tasks_for(spark: SparkSession, n: int) -> int:
    """The session's shuffle partitions, or as many as n rows ask for if these are more."""
    return max(-(-n // ROWS_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
