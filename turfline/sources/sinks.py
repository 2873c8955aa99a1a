"""Files for other programs: CSV with a byte order mark in fixed layouts, and listings of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

#: Headers of the raw fact's file, and the columns of assemble.RAW that they hold, in order.
RAW_LAYOUT = {
    "s2_Numéro": "contest_id", "s3_Discipline": "discipline_raw", "s3_Épreuve": "round_raw", "s4_Clt.": "rank_raw", "s4_Cavalier": "rider", "s4_Club engageur": "club", "s4_Équidé": "horse",
    "s4_Pts qualif. Chpt": "points_raw", "s4_Équipe": "team", "s5_Robe": "coat", "s5_Sexe": "sex", "s5_Taille": "size", "s5_Père": "sire", "s5_Mère": "dam",
}
#: What the file of entries to come holds beyond these, and that of predictions.
FUTURE_LAYOUT = RAW_LAYOUT | {"s2_url": "contest_url", "s3_Date": "date_raw"}
PREDICTION_LAYOUT = RAW_LAYOUT | {
    "classement_predit": "predicted_rank", "proba": "proba", "verdict": "verdict", "is_cold_start": "cold", "model_name": "model", "note": "note", "cheval_courses": "horse_runs", "cheval_victoires": "horse_wins",
    "jockey_courses": "rider_runs", "jockey_victoires": "rider_wins", "duo_courses": "pair_runs", "duo_victoires": "pair_wins", "forme": "form",
}
_MARK = "﻿"


def in_layout(rows: DataFrame, layout: dict[str, str], missing: str = t.MISSING) -> DataFrame:
    """rows under a layout's headers, all as text; columns that rows lack hold `missing`, others are left out."""
    known = set(rows.columns)
    return rows.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in known else F.lit(missing)).alias(h) for h, c in layout.items()])


def write_marked_csv(rows: DataFrame, path: str) -> None:
    """CSV whose parts each begin with a byte order mark and the header, so that spreadsheets read their accents."""
    first, *rest = rows.columns
    marked = rows.select(F.col(f"`{first}`").alias(_MARK + first), *[F.col(f"`{c}`") for c in rest])
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').option("emptyValue", "").csv(path)


def read_marked_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_marked_csv wrote, all as text, blanks as blanks."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip(_MARK) for c in rows.columns]).fillna("")


def write_predictions(rows: DataFrame, path: str, which: Column | None = None) -> int:
    """Predictions of all jobs, or of those for which `which` holds (a job, a contest), in their layout; how many. No file without a row."""
    chosen = rows if which is None else rows.where(which)
    n = chosen.count()
    if n:
        write_marked_csv(in_layout(chosen, PREDICTION_LAYOUT, ""), path)
    return n


def listed_files(spark: SparkSession, folder: str, main: str) -> DataFrame:
    """name, size, modified, is_main, place: the files of a folder that are not empty, the main one first, then the newest; no content is read."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.withColumn("is_main", F.col("name") == main).orderBy(F.desc("is_main"), F.desc("modified"), "name")
