"""Fixed layouts with a byte order mark, listings, calendar menus, encoders and the future fact."""

import os
import time

from pyspark.sql import functions as F

from turfline.operators import assemble, controls, jobs
from turfline.plans.markup import generated
from turfline.sources import sinks

STEP = "pos int, source_url string, href string, attrs map<string,string>"


def test_layouts_have_their_columns():
    assert list(sinks.RAW_LAYOUT.values()) == assemble.RAW and len(sinks.FUTURE_LAYOUT) == 16 and len(sinks.PREDICTION_LAYOUT) == 27


def test_future_entries_round_trip_with_a_mark(spark, tmp_path):
    contests = spark.createDataFrame([(0, "cal", "/c1", {"number": "11"})], STEP)
    rounds = spark.createDataFrame([(0, "/c1", "/r1", {"discipline": "CSO", "round": "Club", "date": "3/5"}), (1, "/c1", "/r1/", {"discipline": "CSO", "round": "Pro", "date": "4/5"})], STEP)
    entries = spark.createDataFrame([(0, "/r1", "", {"horse": 'Éole "le vif", fils', "rank": "1", "points": "8"}), (1, "/none", "", {"horse": "Fée"})], STEP)
    rows = assemble.future_fact(contests, rounds, entries)
    assert [(r.contest_id, r.round_raw, r.rank_raw, r.points_raw, r.contest_url, r.date_raw) for r in rows.orderBy("pos").collect()] == [("11", "Pro", "NONE", "NONE", "/c1", "4/5"), ("NONE", "NONE", "NONE", "NONE", "", "NONE")]
    path = f"file://{tmp_path}/future"
    sinks.write_marked_csv(sinks.in_layout(rows.repartition(2), sinks.FUTURE_LAYOUT), path)
    parts = [p for p in (tmp_path / "future").iterdir() if p.suffix == ".csv"]
    assert parts and all(p.read_bytes().startswith("﻿s2_Numéro,s3_Discipline".encode()) for p in parts)
    back = sinks.read_marked_csv(spark, path)
    assert back.columns == list(sinks.FUTURE_LAYOUT) and {(r["s4_Équidé"], r["s2_url"], r["s5_Robe"]) for r in back.collect()} == {('Éole "le vif", fils', "/c1", "NONE"), ("Fée", "", "NONE")}


def test_predictions_of_one_contest(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", 70, True), ("2", "b", None, False)], "contest_id string, horse string, proba int, cold boolean")
    assert sinks.write_predictions(rows, f"file://{tmp_path}/one", F.col("contest_id") == "1") == 1
    back = sinks.read_marked_csv(spark, f"file://{tmp_path}/one")
    assert back.columns == list(sinks.PREDICTION_LAYOUT) and [(r["s2_Numéro"], r.proba, r.is_cold_start, r.forme) for r in back.collect()] == [("1", "70", "true", "")]
    assert sinks.write_predictions(rows, f"file://{tmp_path}/none", F.col("contest_id") == "9") == 0 and not (tmp_path / "none").exists()
    assert sinks.write_predictions(rows, f"file://{tmp_path}/all") == 2


def test_files_are_listed_main_first_then_newest(spark, tmp_path):
    for i, name in enumerate(["old.csv", "main.csv", "new.csv"]):
        (tmp_path / name).write_text("x" * (i + 1))
        os.utime(tmp_path / name, (time.time() - 1000 + i * 100,) * 2)
    assert [(r.name, r.size, r.is_main) for r in sinks.listed_files(spark, f"file://{tmp_path}", "main.csv").collect()] == [("main.csv", 2, True), ("new.csv", 3, False), ("old.csv", 1, False)]


def test_calendar_menus_and_their_fallback(spark):
    menu = lambda *labels: "<div class='dropdown-menu x'>" + "".join(f"<a class='dropdown-item' href='./?cs={i}'>{x}</a>" for i, x in enumerate(labels)) + "<a href=no>no</a></div>"
    html = menu("Accueil", "Aide") + menu("Toutes régions", "Bretagne", "Normandie") + menu("Championnats : tous concours") + "<div class='dropdown-menu'></div>" + menu("TOUTES DISCIPLINES", "CSO")
    pages = spark.createDataFrame([(1, html, "https://site.example/cal/"), (2, "<p>login</p>", "https://site.example/x")], "k int, html string, page_url string")
    got = {(r.k, r.kind): ([tuple(o) for o in r.options], r.selected, r.degraded) for r in controls.calendar_menus(generated(pages, "k", "html_menus"), pages, "k", ("Toutes", "CSO")).collect()}
    at = "https://site.example/cal/?cs="
    assert got[1, "region"] == ([("Toutes régions", f"{at}0"), ("Bretagne", f"{at}1"), ("Normandie", f"{at}2")], "Toutes régions", False)
    assert got[1, "discipline"][0] == [("TOUTES DISCIPLINES", f"{at}0"), ("CSO", f"{at}1")] and (1, "departement") not in got
    assert got[2, "discipline"] == ([("Toutes", "https://site.example/x"), ("CSO", "https://site.example/x")], "Toutes", True) and len([k for k in got if k[0] == 2]) == 4


def test_stored_encoders_read_categories_as_the_model_did(spark, tmp_path):
    rows = spark.createDataFrame([("B ", 1), ("a", 2), (None, 3)], "kind string, k int")
    jobs.keep_encoders(rows, ["kind"], f"file://{tmp_path}")
    later = spark.createDataFrame([("A", 1), ("b", 2), ("new", 3), (None, 4)], "kind string, k int")
    assert {r.k: r.kind for r in jobs.encoded(later, ["kind"], f"file://{tmp_path}").collect()} == {1: 0, 2: 1, 3: -1, 4: -1}
