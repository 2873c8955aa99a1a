"""Breakers over event streams: rolling counts, streaks, and cursor reads of an event log."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..staging import stage


def _micros(column: str) -> Column:
    """Microseconds since 1970 of a time with or without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def rolling_trips(events: DataFrame, is_hit: Column, key: str, seconds: int, count: int) -> DataFrame:
    """Batch: hits with the number of hits in the seconds before and at them, and whether the breaker trips."""
    hits = events.where(is_hit).withColumn("_us", _micros("ts"))
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return hits.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("trips", F.col("recent") >= count).drop("_us")


def with_runs(events: DataFrame, is_empty: Column, key: str, order: list[Column]) -> DataFrame:
    """events with `place` (from 1 in the key's `order`, which must be total), `island` (successes up to it) and `run` (empty ones right up to it).

    Rows are dealt into staged ranges of (key, order), so a hot key is spread over tasks. A range says of each of its
    keys how many rows and successes it holds and where the last success stands; sums over the ranges before
    give a row its place in the key and the last success before it. Of these summaries there is one
    a range for a key that crosses ranges. Null keys are one key.
    """
    ranges = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = F.col(key).asc_nulls_first()
    dealt = stage(events.withColumn("_ok", ~F.coalesce(is_empty, F.lit(False))).repartitionByRange(ranges, lead, *order).withColumn("_range", F.spark_partition_id()), "runs")
    inside = Window.partitionBy("_range", key).orderBy(*order)
    rows = dealt.withColumn("_place", F.row_number().over(inside)).withColumn("_islands", F.sum(F.col("_ok").cast("int")).over(inside)).withColumn("_last", F.max(F.when(F.col("_ok"), F.col("_place"))).over(inside))
    per = rows.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_in")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_ok").cast("int")).alias("_s"), F.max("_last").alias("_l"))
    before = Window.partitionBy("_key").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_n_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_s_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    # The last success of all ranges before, by its place in the key; 0 without any.
    per = per.withColumn("_l_before", F.coalesce(F.max(F.col("_n_before") + F.col("_l")).over(before), F.lit(0)))
    rows = rows.join(per.select("_key", "_in", "_n_before", "_s_before", "_l_before"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_in")))
    place = F.col("_n_before") + F.col("_place")
    last = F.coalesce(F.col("_n_before") + F.col("_last"), F.col("_l_before"))
    return rows.select(*events.columns, place.alias("place"), (F.col("_s_before") + F.col("_islands")).alias("island"), (place - last).alias("run"))


#: Fixed value: so many empty results in a row end a step.
ABORT_AFTER = 30


def streaks(events: DataFrame, is_empty: Column, key: str, order: str, abort_after: int = ABORT_AFTER) -> DataFrame:
    """Runs of consecutive empty events between successes: key, island, length, first and last order value, and where the key's first run of `abort_after` ended it (null: nowhere)."""
    rows = with_runs(events, is_empty, key, [F.col(order)])
    runs = rows.where("run > 0").groupBy(key, "island").agg(F.count(F.lit(1)).alias("length"), F.min(order).alias("began"), F.max(order).alias("ended"), F.min(F.when(F.col("run") == abort_after, F.col(order))).alias("_trip"))
    trips = runs.groupBy(F.col(key).alias("_key")).agg(F.min("_trip").alias("aborted_at"))
    return runs.join(trips, F.col(key).eqNullSafe(F.col("_key"))).drop("_key", "_trip")


def until_abort(events: DataFrame, is_empty: Column, key: str, order: str, abort_after: int = ABORT_AFTER) -> DataFrame:
    """The events of each key up to the one that makes its first run of `abort_after` empty ones; what follows is cut. With `run`."""
    rows = with_runs(events, is_empty, key, [F.col(order)])
    trips = rows.where(F.col("run") == abort_after).groupBy(F.col(key).alias("_key")).agg(F.min("place").alias("_trip"))
    kept = rows.join(trips, F.col(key).eqNullSafe(F.col("_key")), "left").where(F.col("_trip").isNull() | (F.col("place") <= F.col("_trip")))
    return kept.select(*events.columns, "run")


def after_cursor(log: DataFrame, cursor: int, sequence: str = "event_id") -> DataFrame:
    """What a poller that has seen everything up to `cursor` gets next."""
    return log.where(F.col(sequence) > cursor)


def stream_windows(events: DataFrame, key: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Stream: counts per tumbling window with a watermark."""
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("n"))


def stream_trips(hits: DataFrame, key: str, seconds: int, count: int) -> DataFrame:
    """Stream: the exact sliding breaker; the state of a key holds at most count - 1 times within the window."""

    def step(name: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        out = []
        for at in sorted(t for f in frames for t in f["us"]):
            recent = [t for t in recent if t >= at - seconds * 1_000_000][-(count - 1) :] if count > 1 else []
            recent.append(int(at))
            if len(recent) >= count:
                out.append((name[0], int(at)))
            recent = recent[-(count - 1) :] if count > 1 else []
        state.update((recent,))
        yield pd.DataFrame(out, columns=["key", "us"])

    keyed = hits.select(F.col(key).cast("string").alias("key"), _micros("ts").alias("us"))
    return keyed.groupBy("key").applyInPandasWithState(step, "key string, us long", "recent array<long>", "append", GroupStateTimeout.NoTimeout)
