"""Contests, batches and histories of predictions as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MISSING, verdict


def _present(column: str) -> Column:
    value = F.col(column).cast("string")
    return F.when((value != "") & (value != MISSING), value)


def detail(entries: DataFrame, key: list[str], disciplines: str, rounds: str, dates: str, url: str | None = None) -> DataFrame:
    """Per contest: sorted distinct disciplines, rounds and dates, the most frequent date (smallest on ties), entries, and the smallest url."""
    sets = [F.array_sort(F.collect_set(_present(c))).alias(name) for c, name in ((disciplines, "disciplines"), (rounds, "rounds"), (dates, "dates"))]
    link = [F.coalesce(F.min(_present(url)), F.lit("")).alias("url")] if url else []
    return entries.groupBy(*key).agg(*sets, F.coalesce(F.mode(_present(dates), True), F.lit("")).alias("date"), F.count(F.lit(1)).alias("entries"), *link)


def group_header(rows: DataFrame, group: list[str], proba: str, cold: Column) -> DataFrame:
    """Per displayed group: rows, cold ones, the mean proba of the others (-1 if there is none), by which groups are ordered."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(cold).alias("cold"), F.coalesce(F.round(F.avg(F.when(~cold, F.col(proba))), 6), F.lit(-1.0)).alias("mean_proba"))


def batch_rows(predictions: DataFrame, label: str, stamp: str) -> DataFrame:
    """Predictions in the form of the history table; rows without horse or discipline go.

    predictions: horse, rider, discipline, event, proba (text), rank, verdict, cold. proba becomes a
    whole number of 0 to 100 (0 if unreadable); an empty verdict is derived from it.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    value = F.expr("try_cast(proba AS double)")
    proba = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.bround(F.when(~F.isnan(value), value)).cast("int"), F.lit(0))))
    rows = predictions.where((text("horse") != "") & (text("discipline") != "")).withColumn("_p", proba)
    own = text("verdict")
    cold = F.coalesce(F.col("cold"), F.lit(False))
    source = f"crawl-predict:{label}" if label else "crawl-predict"
    fields = [text("horse"), text("rider"), text("discipline"), text("event")]
    return rows.select(
        F.lit(stamp).alias("ts"),
        *[f.alias(n) for f, n in zip(fields, ("horse", "rider", "discipline", "event"), strict=True)],
        F.lit("").alias("height"),
        F.coalesce(F.expr("try_cast(rank AS int)"), F.lit(0)).alias("rank"),
        F.col("_p").alias("proba"),
        F.when(own != "", own).otherwise(verdict(F.col("_p"), cold)).alias("verdict"),
        cold.alias("cold"),
        F.lit(source).alias("snapshot"),
        F.substring(F.sha1(F.concat_ws("\x1f", F.lit(stamp), *fields)), 1, 12).alias("id"),
    )


def matching(rows: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """Rows in which any of the fields holds the text, in any case."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(text.lower()))
    return rows.where(hit)
