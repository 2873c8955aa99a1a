"""The test tables in the roles of the library's data model.

A line item is a participation: its order a contest, its part a horse, the order's
customer a rider, its supplier a club, its quantity the finishing rank, its discount the
qualification points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import outcome
from ..operators import relational


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def participations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, orders, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    head = F.substring("o_orderpriority", 1, 1)
    n = li.count()  # from the files' footers
    if relational.is_dealt(spark, n):
        # Spark goes by bytes of files, which tell little of what a million parts take as a hash table.
        few = part.count() <= relational.ROWS_A_TASK
        li, part = (li, F.broadcast(part)) if few else (relational.dealt(li, n, "l_partkey"), part.hint("merge"))
    # Orders last: a contest's rows then lie together, for all that goes by contest.
    joined = relational.dealt(li.join(part, F.col("l_partkey") == F.col("p_partkey"), "left"), n, "l_orderkey")
    joined = joined.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = joined.select(
        F.col("l_orderkey").alias("contest"),
        F.col("l_linenumber").alias("round"),
        F.col("l_partkey").alias("horse"),
        F.col("o_custkey").alias("rider"),
        F.col("l_suppkey").alias("club"),
        F.col("l_quantity").cast("int").alias("rk"),
        F.round(F.col("l_discount") * 100).cast("int").alias("pts"),
        (F.col("p_size") * 5).alias("height"),
        F.when(head == "1", 8).when(head == "2", 6).when(head == "3", 5).when(head == "4", 3).otherwise(1).alias("level"),
        F.col("p_type").alias("family"),
        F.col("l_linestatus").alias("team"),
        F.col("o_orderdate").alias("contest_time"),
        F.col("l_shipdate").alias("ship"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("job"),
    )
    return rows.withColumn("won", outcome(F.col("rk"), F.col("pts")))


#: The same rows in DuckDB.
FACT = """fact AS (
  SELECT l_orderkey AS contest, l_linenumber AS round, l_partkey AS horse, o_custkey AS rider, l_suppkey AS club,
         CAST(l_quantity AS INTEGER) AS rk, CAST(round(l_discount * 100) AS INTEGER) AS pts, p_size * 5 AS height,
         CASE o_orderpriority[1] WHEN '1' THEN 8 WHEN '2' THEN 6 WHEN '3' THEN 5 WHEN '4' THEN 3 ELSE 1 END AS level,
         p_type AS family, l_linestatus AS team, o_orderdate AS contest_time, l_shipdate AS ship,
         l_extendedprice AS price, l_tax AS tax, l_returnflag AS job,
         CASE WHEN CAST(l_quantity AS INTEGER) BETWEEN 1 AND 3 OR round(l_discount * 100) >= 8 THEN 1 ELSE 0 END AS won
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey)"""

_ORDER = ["contest", "round", "rider", "club", "horse", "rk", "ship", "price", "tax", "pts", "job", "team"]
#: A total order of participations: contest first, then every column that tells rows apart.
ORDER_SQL = ", ".join(f"{c} NULLS FIRST" for c in _ORDER)
NEWEST_SQL = ", ".join(f"{c} DESC NULLS LAST" for c in _ORDER)
#: The same by time first, for features of a split by date.
TIME_ORDER_SQL = f"contest_time NULLS FIRST, {ORDER_SQL}"


def total_order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in _ORDER]


def time_order() -> list[Column]:
    return [F.col("contest_time").asc_nulls_first(), *total_order()]


def newest_first() -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in _ORDER]
