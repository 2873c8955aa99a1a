"""Sharding by proportional stratified interleaving, with DataFrame expressions only.

Rows are ranked inside their source in a seeded shuffle, sorted by the fractional
rank (2r - 1) / 2n, and cut into shards of equal row counts. Every shard then holds
each source in its share of the whole, to within one row per source and cut.

Law: `rows` - shard sizes differ by one row at most.

Scale: only (doc_id, source, size, crc) is shuffled, never a text. Ranks come from
bucketed offsets (see ranking), and the position in the global order from offsets of
equal-width bins of the fractional rank, which are uniform by construction, so
neither a hot source nor a group of equal texts meets in one task.

Defined results: a null text has no bytes and crc 0; rows with a null source are a
source of their own; ties (repeated rows) go by doc_id, size, crc; an empty table gives
no rows; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import stage
from .ranking import add_group_ranks, bucket_of, shuffle_key


def interleave_shards(docs: DataFrame, shards: int, seed: int = 20, bins: int = 8192, row_overhead: int = 16) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + row_overhead).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shuffle_key(seed, "doc_id").alias("_key"),
    ).withColumn("_bucket", bucket_of(F.col("_key")))
    rows = stage(rows, "shard-rows")
    ties = ["doc_id", "size", "text_crc32"]
    ranked = add_group_ranks(rows, ["source"], "_key", ties, "_rank")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("source", "_src")
    ranked = ranked.join(counts, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    ranked = ranked.withColumn("_frac", (2 * F.col("_rank") - 1) / (2 * F.col("_n"))).withColumn("_bin", F.least(F.floor(F.col("_frac") * bins), F.lit(bins - 1)))
    ranked = stage(ranked.drop("_bucket", "_n"), "shard-ranks")
    per_bin = ranked.groupBy("_bin").agg(F.count(F.lit(1)).alias("_in_bin"))
    # At most `bins` rows, whatever the input: one task may order them.
    every = Window.partitionBy(F.lit(0)).orderBy("_bin")
    offsets = per_bin.select(
        F.col("_bin").alias("_at"),
        F.coalesce(F.sum("_in_bin").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_in_bin").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )
    inside = Window.partitionBy("_bin").orderBy("_frac", F.col("source").asc_nulls_first(), "_key", *ties)
    placed = ranked.join(F.broadcast(offsets), F.col("_bin") == F.col("_at")).withColumn("_pos", F.col("_before") + F.row_number().over(inside) - 1)
    shard = F.expr(f"_pos * {shards} div _total")
    return placed.withColumn("_shard", shard).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        # the first position of a shard is ceil(shard * total / shards)
        (F.col("_pos") - F.expr(f"(_shard * _total + {shards - 1}) div {shards}")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
