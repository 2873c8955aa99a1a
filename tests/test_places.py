"""Running sums, quantiles and prior rates against brute force, with hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turfline.operators import explore, features, learning, places
from turfline.streaming import breaker


def _rows(seed, n=400):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([1, 2, None]), rng.randint(0, 1), rng.randint(0, 50)) for i in range(n)]


SCHEMA = "i long, horse string, rider int, won int, day int"


@pytest.mark.parametrize("hot_rows", [1, 30, 10**9])
def test_running_before_is_the_same_for_hot_and_other_keys(spark, hot_rows):
    rows = _rows(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = places.running_before(df, {"horse": ("hn", "hw"), "rider": ("rn", "rw")}, [F.col("day"), F.col("i")], "won", hot_rows)
    got = {r.i: (r.hn, r.hw, r.rn, r.rw) for r in out.collect()}
    want, seen = {}, {}
    for i, horse, rider, won, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        at = [seen.setdefault(("h", horse), [0, 0]), seen.setdefault(("r", rider), [0, 0])]
        want[i] = (*at[0], *at[1])
        for x in at:
            x[0] += 1
            x[1] += won
    assert got == want


def test_running_sums_over_ranges(spark):
    rows = _rows(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.i: r.before for r in places.with_running(df, [F.col("day"), F.col("i")], {"won": "before"}).collect()}
    total = 0
    for i, *_, won, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        assert got[i] == total
        total += won
    assert places.with_running(df.limit(0), [F.col("i")], {"won": "before"}).count() == 0


def test_quantiles_are_interpolated_and_exact(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0.0] * 9 + [rng.gauss(0, 5)]), rng.choice([None, rng.randint(0, 9)]), None) for _ in range(301)]
    df = spark.createDataFrame(rows, "x double, y int, z double").repartition(4)
    got = {r["column"]: r for r in places.quantiles(df, ["x", "y", "z"], {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    assert set(got) == {"x", "y"}
    for c, values in (("x", [r[0] for r in rows]), ("y", [r[1] for r in rows if r[1] is not None])):
        assert np.allclose([got[c].a, got[c].b, got[c].c], np.quantile(values, [0.1, 0.5, 0.99]))
    filled = explore.impute_medians(df, ["x", "y", "z"]).collect()
    middle = float(np.median([r[1] for r in rows if r[1] is not None]))
    assert sorted(r.y for r in filled) == sorted(middle if r[1] is None else float(r[1]) for r in rows)
    assert all(r.z is None for r in filled)


def test_rates_by_time_never_change_when_later_rows_go(spark):
    rows = _rows(4)
    df = spark.createDataFrame(rows, SCHEMA)
    order = [F.col("day"), F.col("i")]
    rates = lambda x: {r.i: (r.horse_rate, r.horse_starts, r.rider_rate) for r in features.prior_rates(x, {"horse": "horse", "rider": "rider"}, "won", order).collect()}
    every, early = rates(df), rates(df.where("day < 25"))
    assert early and all(every[i] == x for i, x in early.items())


def test_history_of_predictions_counts_no_later_result(spark):
    from turfline.plans import scoring
    from turfline.plans.bindings import participations, time_order

    d = "/root/testdata/sf0.001"
    rows = participations(spark, d)
    early = features.prior_rates(rows.where(F.col("contest_time") < F.lit(scoring.CUT).cast("timestamp")), scoring._KEYS, "won", time_order())
    columns = ["horse", "rider", "horse_rate", "horse_starts", "rider_rate", "rider_starts", "club_rate"]
    told = scoring._history(spark, d).select(*columns)
    assert told.exceptAll(early.select(*columns)).isEmpty() and early.select(*columns).exceptAll(told).isEmpty()
    asked = rows.where(F.col("contest_time") >= F.lit(scoring.CUT).cast("timestamp")).count()
    assert told.count() + asked == rows.count()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_islands_and_aborts_over_ranges(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.random() < rng.choice([0.6, 0.95])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, step string, empty boolean").repartition(6)
    got = {r.i: (r.place, r.island, r.run) for r in breaker.with_runs(df, F.col("empty"), "step", [F.col("i")]).collect()}
    state, want, trips = {}, {}, {}
    for i, step, empty in rows:
        place, island, run = state.get(step, (0, 0, 0))
        state[step] = (place + 1, island + (not empty), run + 1 if empty else 0)
        want[i] = state[step]
        if state[step][2] == 6:
            trips.setdefault(step, i)
    assert got == want
    kept = {r.i for r in breaker.until_abort(df, F.col("empty"), "step", "i", 6).collect()}
    assert kept == {i for i, step, _ in rows if i <= trips.get(step, 10**9)}
    assert {r.step: r.aborted_at for r in breaker.streaks(df, F.col("empty"), "step", "i", 6).collect()} == {step: trips.get(step) for step in {s for _, s, e in rows if e}}


def test_no_events_and_no_successes(spark):
    df = spark.createDataFrame([(i, "s", True) for i in range(40)], "i long, step string, empty boolean")
    assert [(r.length, r.began, r.ended, r.aborted_at) for r in breaker.streaks(df, F.col("empty"), "step", "i").collect()] == [(40, 0, 39, 29)]
    assert breaker.until_abort(df, F.col("empty"), "step", "i").count() == 30
    assert breaker.streaks(df.limit(0), F.col("empty"), "step", "i").count() == 0


def test_exact_curves_and_reports(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0, 1]), rng.choice([0.1, 0.2, 0.2, 0.5, 0.5, 0.9, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "won int, proba double").repartition(4).withColumn("prediction", (F.col("proba") >= 0.5).cast("int"))
    known = [(w, p) for w, p in rows if p is not None]
    pos, neg = [p for w, p in known if w], [p for w, p in known if not w]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    curve = learning.curve_points(df).orderBy(F.desc("threshold")).collect()
    assert [(r.threshold, r.tp, r.fp) for r in curve] == [(x, sum(p >= x for p in pos), sum(p >= x for p in neg)) for x in (0.9, 0.5, 0.2, 0.1)]
    assert abs(sum(r.area for r in curve) - auc) < 1e-12
    report = {r["class"]: r for r in learning.classification_report(df.where("proba IS NOT NULL")).collect()}
    hit = sum(p >= 0.5 for p in pos)
    assert abs(report[1].precision - hit / sum(p >= 0.5 for _, p in known)) < 1e-12 and abs(report[1].recall - hit / len(pos)) < 1e-12
    assert report[0].support == len(neg) and abs(report[1].auc - auc) < 1e-12
    one = spark.createDataFrame([(1, 0.5, 1)], "won int, proba double, prediction int")
    assert {(r.actual, r.predicted): r.n for r in learning.confusion(one).collect()} == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1}
    assert learning.classification_report(one.limit(0)).count() == 2 and learning.curve_points(one.limit(0)).count() == 0


def test_keys_are_told_hot_by_whole_counts_of_few_hashes(spark, monkeypatch):
    monkeypatch.setattr(places, "HASHES", 4)
    rows = spark.range(1000).selectExpr("CASE WHEN id < 300 THEN NULL WHEN id < 700 THEN 7 ELSE id END AS a", "id AS b")
    hot = places._hot_keys(rows, ["a", "b"], 300)
    assert sorted(map(tuple, hot.collect()), key=str) == [("a", "7"), ("a", None)]
    assert places._hot_keys(rows, ["b"], 300).count() == 0


def test_history_computes_only_what_a_query_needs(spark):
    from turfline.plans import scoring

    plan = lambda *columns: scoring._history_rows(spark, "/root/testdata/sf0.001", columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan("horse", "family")
    of_horse = plan("horse", "height", "horse_rate")
    windows = [x for x in of_horse.splitlines() if "Window " in x]
    assert 1 <= len(windows) <= 3 and not any("l_tax" in x or "rider" in x.split("windowspecdefinition")[-1] for x in windows[:1])
