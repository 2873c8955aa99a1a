"""Training and prediction jobs end to end on small tables."""

import json

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from turfline.operators import jobs, learning


def test_training_keeps_models_and_reports(spark, tmp_path):
    rows = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"), F.rand(1).alias("y"), (F.col("id") % 10 >= 6).cast("int").alias("won"))
    reports = jobs.train(rows, ["x", "y"], f"file://{tmp_path}", F.col("id"), models=("tree",), cv=2)
    assert reports[0]["holdout"]["auc"] > 0.95 and set(reports[0]["cv_mean"]) == {"accuracy", "precision", "recall", "f1", "auc"}
    assert json.loads(spark.read.text(f"file://{tmp_path}/tree-report").first()[0])["importances"][0][0] == "x"
    name, model = learning.load_first(f"file://{tmp_path}", ("boosted", "tree"))
    assert name == "tree" and isinstance(model, PipelineModel)
    assert dict(learning.permuted_importances(model, rows, ["x", "y"]))["x"] > 0.3


def test_entries_are_scored_and_ranked(spark):
    columns = "horse long, rider long, family string, height int, level int, won int, rk int, pts int, horse_rate double, horse_starts long, rider_rate double, rider_starts long, club_rate double, field long, team int, sex string, coat string, size string, kind string"
    past = [(h, r, "CSO", 90, 3, w, 4 - 3 * w, 1, 0.2 + 0.6 * w, 2, 0.5, 2, 0.3, 12, 0, "F", "Bai", "P", "G") for h, r, w in ((1, 1, 1), (1, 1, 1), (2, 2, 0), (2, 1, 0))]
    history = spark.createDataFrame(past, columns)
    entries = spark.createDataFrame([(7, "A", 2, 2, "CSO", "2026-01-01"), (7, "A", 1, 1, "CSO", "2026-01-02"), (7, "A", 9, 1, "CSO", "2026-01-02"), (8, "B", 1, None, None, None)], "contest long, round string, horse long, rider long, family string, date string")
    ranked, lines = jobs.predict_entries(entries, history, 100 * F.col("horse_rate"))
    got = {(r.contest, r.horse): (r.predicted_rank, r.proba, r.verdict) for r in ranked.collect()}
    assert got == {(7, 1): (1, 80, "favori"), (7, 2): (2, 20, "outsider"), (7, 9): (3, 30, "cold-start"), (8, 1): (1, None, "inconnu")}
    line = {r.contest: r for r in lines.collect()}
    assert (line[7].entries, line[7].date, line[7].cold, line[7].mean_proba) == (3, "2026-01-02", 1, 50.0)
