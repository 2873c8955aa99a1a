"""The two jobs as compositions: training from a feature table, and predictions of entries to come."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contests, learning, profiles, scoring
from .explore import label_codes, stratified_test


def train(rows: DataFrame, columns: list[str], folder: str, key: Column, models: tuple[str, ...] = ("boosted", "forest", "tree", "logistic"), label: str = "won", cv: int = 5, **sizes: int) -> list[dict]:
    """Fit and keep every model of the catalogue; reports, the best cross-validated F1 first.

    `key` is a total order that draws the hold-out fifth and the folds. A report holds the
    hold-out metrics, mean and standard deviation over the folds, and importances; it is
    stored as JSON beside the model; cv holds all models' means and deviations, features the columns in their order.
    """
    spark, reports, lines = rows.sparkSession, [], []
    split = stratified_test(rows, label, key)
    folded = learning.folds(split.where("NOT is_test"), key, cv, label) if cv else None
    for name in models:
        fitted = learning.fit(split.where("NOT is_test"), columns, name, label, **sizes)
        held = learning.evaluate(learning.score(fitted, split.where("is_test")), label)
        folds = [asdict(m) for m in learning.cross_validate(folded, columns, name, cv, label, **sizes)] if folded is not None else []
        mean = {k: sum(f[k] for f in folds) / len(folds) for k in folds[0]} if folds else {}
        spread = {k: (sum((f[k] - mean[k]) ** 2 for f in folds) / len(folds)) ** 0.5 for k in mean}
        reports.append({"model": name, "holdout": asdict(held), "cv_mean": mean, "cv_std": spread, "features": columns, "importances": learning.importances(fitted, columns)[:20]})
        fitted.write().overwrite().save(f"{folder}/{name}")
        spark.createDataFrame([(json.dumps(reports[-1]),)], "report string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}-report")
        lines += [(name, k, mean[k], spread[k]) for k in mean]
    if lines:  # a row a model and metric
        spark.createDataFrame(lines, "model string, metric string, mean double, std double").groupBy("model").pivot("metric").agg(F.first("mean").alias("mean"), F.first("std").alias("std")).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/cv")
    spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "place int, feature string").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/features")
    return sorted(reports, key=lambda r: (-(r["cv_mean"] or r["holdout"])["f1"], r["model"]))


def predict_entries(entries: DataFrame, history: DataFrame, proba: Column) -> tuple[DataFrame, DataFrame]:
    """Predictions of entries (contest, round, horse, rider, family, date) with verdict and predicted rank, and a line per contest.

    Within a contest and round known pairs come first, by proba; cold ones follow.
    """
    rows = scoring.batch(history, entries, proba)
    order = [F.col("cold"), F.desc_nulls_last("proba"), F.col("horse").asc_nulls_last(), F.col("rider").asc_nulls_last()]
    ranked = profiles.ranked_within(rows, ["contest", "round"], order, "predicted_rank")
    lines = contests.detail(entries, ["contest"], "family", "round", "date")
    means = contests.group_header(ranked, ["contest"], "proba", F.col("cold"))
    return ranked, lines.join(means.select("contest", "cold", "mean_proba"), "contest", "left")


def keep_encoders(rows: DataFrame, columns: list[str], folder: str) -> None:
    """The label codes of every column as a table: value, code; what a scoring job needs to read categories as the model did."""
    for c in columns:
        label_codes(rows, c).write.mode("overwrite").parquet(f"{folder}/encoder-{c}")


def encoded(rows: DataFrame, columns: list[str], folder: str) -> DataFrame:
    """rows with stored codes in place of categories; -1 for values that the encoder has not seen."""
    for c in columns:
        codes = rows.sparkSession.read.parquet(f"{folder}/encoder-{c}").select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        rows = rows.join(codes, F.lower(F.trim(F.col(c).cast("string"))) == F.col("_value"), "left").withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_value", "_code")
    return rows
