"""From raw step tables to the raw fact, and from the raw fact to the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from . import features, relational

#: Columns of the raw fact, all text, "NONE" where a lookup missed.
RAW = ["contest_id", "discipline_raw", "round_raw", "rank_raw", "rider", "club", "horse", "points_raw", "team", "coat", "sex", "size", "sire", "dam"]


def normalised_url(x: Column) -> Column:
    """Trimmed, without fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(t.strip(x), "#.*$", ""), "/+$", "")


def raw_fact(contests: DataFrame, rounds: DataFrame, entries: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Entries with their round, contest and card looked up by URL; the last duplicate of a page wins.

    Tables are (pos, source_url, href, attrs map). Every entry stays, whatever misses.
    """

    def dimension(table: DataFrame, key: str, name: str) -> DataFrame:
        keyed = table.select(normalised_url(F.col(key)).alias(f"_{name}_key"), normalised_url(F.col("source_url")).alias(f"_{name}_from"), F.col("attrs").alias(f"_{name}"), F.col("pos").alias(f"_{name}_pos"))
        return relational.last_wins(keyed, f"_{name}_key", [F.desc(f"_{name}_pos")])

    e = entries.select("pos", normalised_url(F.col("source_url")).alias("_round_key"), normalised_url(F.col("attrs")["horse_url"]).alias("_card_key"), F.col("attrs").alias("_e"))
    e = e.join(dimension(rounds, "href", "round"), "_round_key", "left")
    e = e.join(dimension(contests, "href", "contest"), F.col("_round_from") == F.col("_contest_key"), "left")
    if cards is None:
        e = e.withColumn("_card", F.lit(None).cast("map<string,string>"))
    else:
        e = e.join(dimension(cards, "source_url", "card"), "_card_key", "left")
    source = {"contest_id": ("_contest", "number"), "discipline_raw": ("_round", "discipline"), "round_raw": ("_round", "round"), "rank_raw": ("_e", "rank"), "points_raw": ("_e", "points")}
    source |= {c: ("_e", c) for c in ("rider", "club", "horse", "team")} | {c: ("_card", c) for c in ("coat", "sex", "size", "sire", "dam")}
    return e.select("pos", *[t.first_value(F.try_element_at(F.col(m), F.lit(k))).alias(c) for c, (m, k) in source.items()])


def future_fact(contests: DataFrame, rounds: DataFrame, entries: DataFrame) -> DataFrame:
    """raw_fact of entries to come: no card, no rank and no points, but contest_url and date_raw."""
    dated = rounds.select(normalised_url(F.col("href")).alias("_key"), t.first_value(F.col("attrs")["date"]).alias("date_raw"), normalised_url(F.col("source_url")).alias("_contest"), F.col("pos").alias("_pos"))
    dated = relational.last_wins(dated, "_key", [F.desc("_pos")]).drop("_pos")
    known = entries.select("pos", normalised_url(F.col("source_url")).alias("_key")).join(dated, "_key", "left").drop("_key")
    rows = raw_fact(contests, rounds, entries).withColumns({"rank_raw": F.lit(t.MISSING), "points_raw": F.lit(t.MISSING)})
    return rows.join(known, "pos").select("pos", *RAW, F.coalesce("_contest", F.lit("")).alias("contest_url"), F.coalesce("date_raw", F.lit(t.MISSING)).alias("date_raw"))


def propagated_header(rows: DataFrame, table: str, position: str, header: str, value: str) -> DataFrame:
    """A team header fills the empty cells of the rows below it, up to the next header."""
    w = Window.partitionBy(table).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.col(header), ignorenulls=True).over(w)
    return rows.withColumn(value, F.when(t.strip(F.coalesce(F.col(value), F.lit(""))) == "", above).otherwise(F.col(value)))


def feature_table(raw: DataFrame, strict_reference: bool = False, with_points: bool = True) -> DataFrame:
    """The feature table from the raw fact (RAW columns and pos, its ingestion order).

    Rates look at strictly earlier rows in the order of contest, then position. Rows with a
    negative rank shape the histories and leave afterwards. Text that is no number is no
    rank, and 0 points.
    """
    rank = F.col("rank_raw").try_cast("double").cast("int")
    rows = raw.select(
        "pos",
        F.col("contest_id").try_cast("long").alias("contest_id"),
        t.name_key(F.col("horse")).alias("horse"),
        t.name_key(F.col("rider")).alias("rider"),
        t.strip(F.col("club")).alias("club"),
        "coat",
        "sex",
        "size",
        F.col("round_raw"),
        t.event_family(F.col("discipline_raw")).alias("family"),
        t.height_cm(F.coalesce("discipline_raw", F.lit(""))).alias("height"),
        t.event_level(F.coalesce("round_raw", F.lit(""))).alias("level_name"),
        t.event_kind(F.coalesce("round_raw", F.lit(""))).alias("kind"),
        t.is_team(F.col("team")).alias("is_team"),
        rank.alias("rk"),
        F.coalesce(F.col("points_raw").try_cast("double"), F.lit(0.0)).alias("pts"),
    )
    rows = rows.withColumn("level", t.level_ordinal(F.col("level_name"))).withColumn("won", t.outcome(F.col("rk"), F.col("pts"), strict_reference))
    rows = features.field_size(rows, ["contest_id", "round_raw"], "rk", "field_size")
    order = [F.col("contest_id").asc_nulls_first(), F.col("pos")]
    rows = features.prior_rates(rows, {"horse": "horse", "rider": "rider", "club": "club"}, "won", order)
    rows = features.interactions(rows).withColumn("density", t.field_size_bin(F.col("field_size")))
    for name in ("horse", "rider", "club"):
        ids = relational.surrogate_ids(rows, name, "pos", f"{name}_id")
        rows = rows.join(ids, name, "left").withColumn(f"{name}_id", F.coalesce(f"{name}_id", F.lit(0)))
    rows = rows.where(F.col("rk").isNull() | (F.col("rk") >= 0)).drop("round_raw")
    return rows if with_points else rows.drop("pts")
