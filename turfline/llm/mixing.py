"""Mixing sources to target weights by capped water-filling.

Every source wants its weight's share of the total size. Sources whose share is
above `max_epochs` times their own size are clamped there, and the excess goes to
the others by weight, until none is above its cap. A source's target then becomes
whole repetitions of all its documents, plus a seeded fractional repetition: the
documents in shuffled order up to the target, the last of them in part.

Water-filling in one pass: with sources in the order of cap / weight, the clamped
ones are a prefix, found by two running sums over the table of sources. All sums
are integers, so every engine and rerun gets the same targets.

Scale: text is read once; after that only (doc_id, source, size) moves. Running sums
inside a source come from bucketed offsets (see ranking), so a source with a third
of all rows is never in one task. The table of sources (one row each) is ordered in
ranges with running sums, so as many sources as there are domains don't meet in one task.

Defined results: a null text has size 0; rows with a null source form the last
source; a source without words has target 0; with no words at all every target is 0;
repeated rows are documents of their own; an empty table gives no rows; other input
columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..operators.places import with_place, with_running
from ..staging import stage
from .ranking import add_group_ranks, bucket_of, shuffle_key
from .text_stats import WORD_PATTERN

WEIGHTS = (5, 2, 1)
#: Rows of the table of sources that may be broadcast.
BROADCAST_SOURCES = 100_000


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """sources(source, source_size) -> source, source_size, weight, target.

    Weights repeat over the sources in code-point order, null last.
    """
    big = "decimal(38,0)"
    ranked = with_place(sources, [F.col("source").asc_nulls_last()], "_i").withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_i") - 1) % len(weights) + 1).cast("int")))
    ranked = with_running(ranked.withColumn("_cap", F.col("source_size") * max_epochs), [F.col("_cap") / F.col("weight"), F.col("_i")], {"_cap": "_cap_before", "weight": "_weight_before"})
    whole = ranked.agg(F.sum("source_size").alias("_total"), F.sum("weight").alias("_weights"))  # one row
    ranked = (
        ranked.join(F.broadcast(whole))
        .withColumn("_weight_left", F.col("_weights") - F.col("_weight_before"))
        .withColumn("_left", F.col("_total") - F.col("_cap_before"))
        .withColumn("_clamped", F.col("weight").cast(big) * F.col("_left").cast(big) >= F.col("_cap").cast(big) * F.col("_weight_left").cast(big))
    )
    # What the clamped sources leave, and the weight that shares it.
    kept = ranked.agg(F.coalesce(F.sum(F.when(F.col("_clamped"), F.col("_cap"))), F.lit(0)).alias("_held"), F.coalesce(F.sum(F.when(~F.col("_clamped"), F.col("weight"))), F.lit(0)).alias("_pool_weight"))  # one row
    ranked = ranked.join(F.broadcast(kept)).withColumn("_pool", F.col("_total") - F.col("_held"))
    target = F.when(F.col("_clamped"), F.col("_cap").cast("double")).otherwise((F.col("weight") * F.col("_pool")).cast("double") / F.greatest(F.col("_pool_weight"), F.lit(1)))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 5) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, repeats, part.

    taken = repeats * size + part: `repeats` whole copies, then the first `part` words.
    """
    return allot(_sized(docs, seed), weights, max_epochs).drop("_key", "_bucket")


def _size() -> F.Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    rows = docs.select("doc_id", "source", _size().alias("size"), shuffle_key(seed, "doc_id").alias("_key"))
    return stage(rows.withColumn("_bucket", bucket_of(F.col("_key"))), "mix-rows")


def allot(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """mix_sources for rows that already carry size, _key and _bucket; they may hold more columns."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(sources, weights, max_epochs)
    ranked = add_group_ranks(rows, ["source"], "_key", ["doc_id", "size"], "_rank", {"size": "_words_before"})
    targets = targets.withColumnRenamed("source", "_src")
    out = ranked.join(targets, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    out = out.withColumn("repeats", F.least(whole, F.lit(max_epochs).cast("bigint")))
    budget = F.floor(F.col("target") - F.col("repeats") * F.col("source_size")).cast("bigint")
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), budget - F.col("_words_before")))
    out = out.withColumn("part", F.when(F.col("repeats") >= max_epochs, F.lit(0).cast("bigint")).otherwise(part))
    out = out.withColumn("taken", F.col("repeats") * F.col("size") + F.col("part"))
    return out.drop("_rank", "_words_before", "weight")


@F.pandas_udf(StringType())
def _first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    def cut(text: str, n: int) -> str:
        for i, word in enumerate(re.finditer(WORD_PATTERN, text), 1):
            if i == n:
                return text[: word.end()]
        return text

    return pd.Series([cut(x, n) for x, n in zip(texts, counts, strict=True)], dtype="object")


def materialize_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 5) -> DataFrame:
    """The mix itself, with all columns of docs: every whole repetition is a row, and a part is a row cut after its last word.

    What a row takes follows from its source's repeats and from the last row that the
    source takes a part of, so one row per source is joined back and no text is
    shuffled, but those of rows that tie with that last row (repeated rows of one
    doc_id): these are numbered by their text's hash. n_chars, where it is a column,
    follows the text.
    """
    rows = stage(allot(_sized(docs, seed), weights, max_epochs).select("source", "_key", "doc_id", "size", "repeats", "part"), "mix-shares")
    place = F.struct("_key", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size")
    limits = rows.groupBy(F.col("source").alias("_source")).agg(F.max("repeats").alias("_repeats"), F.max(F.when(F.col("part") > 0, place)).alias("_last"))
    limits = stage(limits, "mix-limits")
    at_last = rows.join(limits, F.col("source").eqNullSafe(F.col("_source"))).where(place == F.col("_last"))
    ties = at_last.groupBy(F.col("source").alias("_tied")).agg(F.count_if(F.col("part") == F.col("size")).alias("_full"), F.coalesce(F.max(F.when(F.col("part") < F.col("size"), F.col("part"))), F.lit(0)).alias("_rest"))
    limits = limits.join(ties, F.col("_source").eqNullSafe(F.col("_tied")), "left").drop("_tied")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_SOURCES else limits
    names = docs.columns
    out = docs.join(limits, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_size", _size())
    mine = F.struct(shuffle_key(seed, "doc_id").alias("_key"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_size").alias("size"))
    tied = F.coalesce(mine == F.col("_last"), F.lit(False))
    none = F.lit(0).cast("bigint")
    before = out.where(~tied).withColumn("_part", F.when(F.col("_last").isNull() | (mine > F.col("_last")), none).otherwise(F.col("_size")))
    number = F.row_number().over(Window.partitionBy("_source").orderBy(F.xxhash64("text"), "text"))
    last = out.where(tied).withColumn("_number", number)
    last = last.withColumn("_part", F.when(F.col("_number") <= F.col("_full"), F.col("_size")).when(F.col("_number") == F.col("_full") + 1, F.col("_rest")).otherwise(none)).drop("_number")
    out = before.unionByName(last)
    whole = F.array_repeat(F.lit(None).cast("bigint"), F.col("_repeats").cast("int"))
    takes = F.when(F.col("_part") >= F.col("_size"), F.array_append(whole, F.lit(None).cast("bigint"))).when(F.col("_part") > 0, F.array_append(whole, F.col("_part"))).otherwise(whole)
    out = out.where(F.col("_size") > 0).withColumn("_take", F.explode(takes))
    text = F.when(F.col("_take").isNull(), F.col("text")).otherwise(_first_words(F.when(F.col("_take").isNotNull(), F.col("text")).otherwise(F.lit("")), F.coalesce("_take", F.lit(0))))
    out = out.withColumn("_text", text).drop("text").withColumnRenamed("_text", "text")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_take").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return out.select(*names)
