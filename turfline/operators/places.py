"""Places in one total order, or in few large groups, without a task that orders everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import stage


def with_place(rows: DataFrame, order: list[Column], name: str, group: str | None = None) -> DataFrame:
    """rows with their place from 1 in `order`, which must be total; inside `group` if that is given.

    Rows are dealt into ranges, which are staged so that a lost task can't deal them anew; a
    place is the row's number in its range plus the sizes of the ranges before (one
    row a range). A group is a run of this order, so its first place is taken off: groups
    should be few, their table has one row each. Equal rows in `order` go to one range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = [F.col(group).asc_nulls_first()] if group else []
    dealt = stage(rows.repartitionByRange(ranges, *lead, *order).withColumn("_range", F.spark_partition_id()), "places")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*lead, *order)
    placed = dealt.join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("bigint")).drop("_range", "_before")
    if group is None:
        return placed
    of_group = dealt.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_size"))
    starts = of_group.withColumn("_start", F.coalesce(F.sum("_size").over(Window.orderBy(F.col("_group").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")))
    return placed.withColumn(name, F.col(name) - F.col("_start")).withColumnRenamed("_size", f"{name}_of").drop("_group", "_start")


def with_running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with the sums of columns over all rows before them in `order`, which must be total: {column: name}."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "running-sums")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])  # a row a range
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, name in sums.items()}).join(F.broadcast(offsets), "_range")
    return out.withColumns({name: F.col(name) + F.col(f"_o_{c}") for c, name in sums.items()}).drop("_range", *[f"_o_{c}" for c in sums])


def quantiles(rows: DataFrame, columns: list[str], shares: dict[str, float]) -> DataFrame:
    """column and, per entry of `shares`, the exact, interpolated quantile; a row per column that holds a number.

    Values are counted before they are ordered, so a frequent one is a row, and ordered in ranges.
    """
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")).select("c.*").where("x IS NOT NULL")
    counts = cells.groupBy("column", "x").agg(F.count(F.lit(1)).alias("_n"))
    placed = with_running(counts, [F.col("column"), F.col("x")], {"_n": "_before"})
    per = placed.groupBy("column").agg(F.sum("_n").alias("_total"), F.min("_before").alias("_start"))  # a row a column
    placed = placed.join(F.broadcast(per), "column").withColumn("_before", F.col("_before") - F.col("_start"))
    at = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col("x")))
    ends = []
    for name, share in shares.items():
        place = (F.col("_total") - 1) * F.lit(share)
        ends += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    found = placed.groupBy("column").agg(*ends)
    return found.select("column", *[((1 - F.col(f"_part_{n}")) * F.col(f"_lo_{n}") + F.col(f"_part_{n}") * F.col(f"_hi_{n}")).alias(n) for n in shares])


#: From this many rows on a key's rows are dealt into ranges instead of one task.
HOT_ROWS = 200_000


def running_before(rows: DataFrame, keys: dict[str, tuple[str, str]], order: list[Column], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each key column -> (count, total): how many rows of the row's key come before it in `order`, which must be total, and the sum of `value` over these.

    Hot keys are told once for all columns (see _hot_keys). A window serves those with fewer than `hot_rows` rows;
    the rows of the others go by ranges (see _in_ranges). Hot keys are broadcast: there is one
    in `hot_rows` rows at most. Null keys are one key.
    """
    hot = _hot_keys(rows, list(keys), hot_rows)
    heated = {r["column"] for r in hot.select("column").distinct().collect()}  # at most the names in `keys`
    for key, (count, total) in keys.items():
        by_key = Window.partitionBy(key).orderBy(*order)
        sums = {count: (F.row_number().over(by_key) - 1).cast("bigint"), total: F.coalesce(F.sum(value).over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
        if key not in heated:
            rows = rows.withColumns(sums)
            continue
        rows = stage(rows, "running-rows")
        names = F.broadcast(hot.where(F.col("column") == key).select("value"))
        same = F.col(key).cast("string").eqNullSafe(F.col("value"))
        cold = rows.join(names, same, "left_anti").withColumns(sums)
        rows = cold.unionByName(_in_ranges(rows.join(names, same, "left_semi"), key, order, value, count, total))
    return rows


#: Keys are first counted by so many hashes: a few thousand counts a task instead of nearly every row.
HASHES = 1 << 16


def _hot_keys(rows: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """column, value (as text): staged, the keys with `hot_rows` rows or more. Only keys whose hash has so many rows are counted themselves."""
    named = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")).select("k.*")
    named = named.withColumn("hash", F.pmod(F.xxhash64("value"), F.lit(HASHES)))
    full = stage(named.groupBy("column", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_rows).drop("n"), "hot-hashes")
    if full.isEmpty():
        return full.select("column", F.lit(None).cast("string").alias("value"))
    counts = named.join(F.broadcast(full), ["column", "hash"], "left_semi").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return stage(counts.where(F.col("n") >= hot_rows).select("column", "value"), "hot-keys")


def _in_ranges(rows: DataFrame, key: str, order: list[Column], value: str, count: str, total: str) -> DataFrame:
    """running_before for one key column, with rows dealt into staged ranges of (key, order).

    A hot key is spread over ranges; only a key that crosses ranges needs offsets, and of
    these there are less than two rows a range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.repartitionByRange(ranges, F.col(key).asc_nulls_first(), *order).withColumn("_range", F.spark_partition_id()), "running")
    per = dealt.groupBy(F.col(key).alias("_key"), "_range").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(value), F.lit(0)).alias("_s"))
    # A key lies in neighbouring ranges, so one that crosses is the first or the last of a range.
    ends = per.groupBy("_range").agg(F.min(F.struct(F.col("_key").isNotNull(), "_key")).alias("lo"), F.max(F.struct(F.col("_key").isNotNull(), "_key")).alias("hi"))
    ends = ends.select(F.explode(F.array("lo._key", "hi._key")).alias("_end")).distinct()
    crossing = per.join(F.broadcast(ends), F.col("_key").eqNullSafe(F.col("_end")), "left_semi")  # at most two keys a range
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = crossing.select("_key", F.col("_range").alias("_in"), F.sum("_n").over(before).alias("_n"), F.sum("_s").over(before).alias("_s")).where("_n IS NOT NULL")
    inside = Window.partitionBy("_range", key).orderBy(*order)
    out = dealt.withColumn(count, F.row_number().over(inside) - 1).withColumn(total, F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_in")), "left")
    sums = {count: (F.col(count) + F.coalesce("_n", F.lit(0))).cast("bigint"), total: F.col(total) + F.coalesce("_s", F.lit(0))}
    return out.withColumns(sums).drop("_range", "_key", "_in", "_n", "_s")
