"""Preprocessing for models as one fitted pipeline: features made if absent, label codes, medians, the feature matrix."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import field_size_bin, level_ordinal
from .explore import label_codes, median

#: Columns that are never features: names, keys, dates, and the targets.
EXCLUDED = ("contest", "round", "horse", "rider", "club", "contest_time", "ship", "price", "tax", "job", "won", "rk")
UNKNOWN = "inconnu"


def add_missing_features(rows: DataFrame) -> DataFrame:
    """synergy, density, level_num and experience, each only if it is absent and its sources are there."""
    have = set(rows.columns)
    made = {
        "synergy": (("horse_rate", "rider_rate"), lambda: F.col("horse_rate") * F.col("rider_rate")),
        "density": (("field",), lambda: field_size_bin(F.col("field"))),
        "level_num": (("level_name",), lambda: level_ordinal(F.col("level_name"))),
        "experience": (("horse_starts", "height"), lambda: F.col("horse_starts") / (F.col("height") / 10 + 1)),
    }
    return rows.withColumns({c: make() for c, (needs, make) in made.items() if c not in have and have.issuperset(needs)})


def feature_columns(rows: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> list[str]:
    return [c for c in rows.columns if c not in excluded]


@dataclass
class Preprocessor:
    """Label codes (value, code) per category and medians per number, fitted on training rows.

    A value that training never held, and a null, takes the code 0, the first class.
    """

    codes: dict[str, DataFrame]
    medians: DataFrame
    numbers: list[str]

    def transform(self, rows: DataFrame) -> DataFrame:
        order = rows.columns
        for c, table in self.codes.items():
            named = table.select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
            value = F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))))
            rows = rows.join(named, value == F.col(f"_v_{c}"), "left").withColumn(c, F.coalesce(f"_c_{c}", F.lit(0)).cast("int")).drop(f"_v_{c}", f"_c_{c}")
        rows = rows.join(F.broadcast(self.medians), how="left")  # one row
        numbers = {c: F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.col(f"_m_{c}")) for c in self.numbers}
        return rows.withColumns(numbers).select(*order)


def fit_preprocessor(rows: DataFrame, categories: list[str], numbers: list[str]) -> Preprocessor:
    codes = {}
    for c in categories:
        filled = rows.select(F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c))
        codes[c] = label_codes(filled, c)
    each = [median(rows.select(F.expr(f"try_cast(`{c}` AS double)").alias(c)), c, f"_m_{c}") for c in numbers]
    medians = reduce(lambda a, b: a.join(F.broadcast(b)), each, rows.sparkSession.range(1).select())  # one row
    return Preprocessor(codes, medians, numbers)


def preprocess(rows: DataFrame, train: F.Column, categories: list[str], numbers: list[str], target: str = "won") -> tuple[DataFrame, list[str]]:
    """The whole pipeline: features made, codes and medians fitted where `train` holds, applied to all rows; with the feature names."""
    rows = add_missing_features(rows)
    done = fit_preprocessor(rows.where(train), categories, numbers).transform(rows)
    names = [c for c in feature_columns(done) if c != target]
    return done, names
