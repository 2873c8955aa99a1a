"""Exact ranks and running sums in huge groups without a task that holds a group.

Rows get a seeded shuffle key, the md5 of "seed:doc_id" in hex, whose first digits
are an order-preserving bucket. Counts and sums per (group, bucket) are small and
pre-aggregated before the shuffle; their running totals are the offsets that turn a
rank inside one bucket into a rank inside the group. A bucket of a group that holds
a third of 10^10 rows has under 10^6 rows with the default of 4096 buckets.

Defined results: nulls in a group column are one group; rows that agree in key and ties, such as repeated rows, get
neighbouring ranks in an order that may change from run to run, so ties should name every column that a
rank decides on; a null id has the key of the empty string, and so all rows without ids fall into one bucket
unless other columns enter the key; nulls in a summed column count as nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_DIGITS = 3


def shuffle_key(seed: int, *columns: str) -> Column:
    """md5 hex of "seed:value[:value...]"; a null value counts as the empty string."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def bucket_of(key: Column, digits: int = BUCKET_DIGITS) -> Column:
    return F.substring(key, 1, digits)


def add_group_ranks(rows: DataFrame, group: list[str], key: str, ties: list[str], rank: str, sums: dict[str, str] | None = None, bucket: str = "_bucket") -> DataFrame:
    """Adds `rank` (from 1, in the order of key then ties, inside group) and running sums.

    rows must hold the bucket column, a prefix of key. `sums` maps a numeric column
    to the name of its running sum over the rows before this one.
    """
    sums = sums or {}
    per_bucket = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col(bucket).alias("_g_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums],
    )
    on = F.col(bucket) == F.col("_g_bucket")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = Window.partitionBy(*group, bucket).orderBy(key, *ties)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(offsets, on).withColumn(rank, F.col("_before") + F.row_number().over(inside))
    for c, out in sums.items():
        ranked = ranked.withColumn(out, F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(prior), F.lit(0)))
    return ranked.drop("_before", "_g_bucket", *[f"_g_{c}" for c in group], *[f"_b_{c}" for c in sums])
