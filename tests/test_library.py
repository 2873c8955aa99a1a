"""Edge rows, invariants and round trips of the library's own operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from turfline.functions import html_rows
from turfline.functions import text as t
from turfline.operators import documents, explore, features, learning, profiles, relational
from turfline.sources import state, tabular
from turfline.streaming import breaker


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_labels(spark):
    values = ["CSO 80 cm", "Hunter 90 CM GP", "Equifun (+2)", "", None, " CCE  110cm x"]
    assert column(spark, values[:4] + values[5:], t.height_cm) == [80, 90, 0, 0, 110]
    assert column(spark, values[:4] + values[5:], t.event_family) == ["CSO", "Hunter 90 CM GP", "Equifun", "Autre", "CCE"]
    assert column(spark, ["Promotion", "Club 2 Elite", "As Poney", "x"], t.event_level) == ["Pro", "Elite", "As", "Club"]
    assert column(spark, [" individuel ", "x", None], t.is_team) == [0, 1, 1]


def test_scores_and_places(spark):
    assert column(spark, ["0.5", "1", "62,5 %", "2.5", "3.5", "140", "n/a", "", None], t.percent_score) == [50, 100, 62, 2, 4, 100, None, None, None]
    assert column(spark, ["1 er", "3ème", "Éliminé", "El.", "x", "12 e ex aequo"], t.clean_ordinal) == ["1", "3", "-1", "-1", "x", "12"]
    assert column(spark, ["Forfait", "hors concours", "Épreuve annulée", "4"], t.did_not_start) == [True, True, True, False]
    assert column(spark, ["1.5", "-1", "tard", " "], t.ranking_number) == ["1.5", "-1", "-1", " "]


def test_dates_and_urls(spark):
    assert column(spark, ["03/04/2026", "2026-04-03", "31/02/2026", "x"], t.date_to_iso) == ["2026-04-03", "2026-04-03", None, None]
    assert column(spark, ["Avril 2026", "2026, FÉVRIER", "printemps"], t.month_heading) == ["2026-04", "2026-02", None]
    urls = ["https://ex.com/product/12345?b=1&a=2", "https://ex.com/u/deadbeef01/my-product-123", "nope", "http://h"]
    assert column(spark, urls, t.url_template) == ["https://ex.com/product/:id?a=:val&b=:val", "https://ex.com/u/:id/:id", "", "http://h/"]
    assert column(spark, ["https://Site/É a--b!"], t.slug) == ["site_é_a_b"]


def test_first_value_and_presence(spark):
    assert column(spark, [" a ", "none", "", None], lambda x: t.first_value(x)) == ["a", "NONE", "NONE", "NONE"]
    assert column(spark, ["a", " NONE ", "-1", "", None], t.has_value) == [True, False, False, False, False]


def test_lookup_keeps_the_number_of_facts(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "i int, k string")
    dim = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1), ("", "blank", 1)], "k string, v string, pos int")
    got = {r.i: r.v for r in relational.lookup(facts, dim, "k", [F.desc("pos")]).collect()}
    assert got == {1: "new", 2: "x", 3: None, 4: None}


def test_dedup_is_idempotent_and_ignores_provenance(spark):
    rows = spark.createDataFrame([(0, {"a": "1", "source_url": "x"}), (1, {"source_url": "y", "a": "1"}), (2, {"a": " "}), (3, {"a": "2"})], "pos int, attrs map<string,string>")
    once = relational.dedup_rows(rows, "attrs", "pos", ["source_url"])
    assert sorted(r.pos for r in once.collect()) == [0, 3]
    assert sorted(r.pos for r in relational.dedup_rows(once, "attrs", "pos", ["source_url"]).collect()) == [0, 3]


def test_prior_rates_never_look_ahead(spark):
    rows = [(1, i, i % 3 == 0) for i in range(20)]
    make = lambda flip: spark.createDataFrame([(h, i, int(w != (flip and i >= 12))) for h, i, w in rows], "horse int, pos int, won int")
    rates = lambda df: [r.h_rate for r in features.prior_rates(df, {"horse": "h"}, "won", [F.col("pos")]).orderBy("pos").collect()]
    a, b = rates(make(False)), rates(make(True))
    assert a[:13] == b[:13] and a[0] == 0.3 and a[1] == 1.0 and a[13:] != b[13:]


def test_cascade_picks_the_narrowest_scope_or_the_broadest(spark):
    history = [("h1", "CSO", 80, 3, 1, 1)] * 3 + [("h1", "CSO", 90, 3, 0, 5)] + [("h2", "CCE", 80, 3, 1, 2)] * 2
    h = spark.createDataFrame(history, "horse string, family string, height int, level int, won int, rk int")
    q = spark.createDataFrame([("h1", "CSO", 80, 3), ("h1", "CSO", 90, 5), ("h1", "CCE", 80, 3), ("h2", "CCE", 80, 3)], "horse string, family string, height int, level int")
    got = {(r.horse, r.family, r.height): (r.scope, r.starts, r.low_data) for r in profiles.cascade(h, q, "horse").collect()}
    assert got == {("h1", "CSO", 80): ("family_height_level", 3, False), ("h1", "CSO", 90): ("family", 4, False), ("h1", "CCE", 80): ("all", 4, False), ("h2", "CCE", 80): ("all", 2, True)}


def test_rank_estimate_is_half_even(spark):
    rows = spark.createDataFrame([(100, 11.0), (0, 11.0), (75, 11.0), (50, None), (25, 1.0)], "p int, n double")
    assert [r[0] for r in rows.select(profiles.estimated_rank(F.col("p"), F.col("n"))).collect()] == [1, 11, 3, 7, 2]


def test_uniform_rows_leave_few_rows_alone(spark):
    rows = spark.createDataFrame([("x", None)] * 4, "a string, b string")
    has = {c: t.has_value(F.col(c)) for c in "ab"}
    assert explore.uniform_rows(rows, ["a", "b"], has).count() == 4


def test_readers_of_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Cheval;Cavalier;Discipline;Proba\nÉclair;Ann;CSO;62,5 %\n;Bob;CSO;1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("discipline,horse,id\nCCE,Éole,7\nCCE,Éole,7\n", encoding="windows-1252")
    rows = tabular.read_directory(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"]).orderBy("file").collect()
    assert [(r.horse, r.family, r.file) for r in rows] == [("Éclair", "CSO", "a.csv"), ("Éole", "CCE", "b.csv")]
    again = tabular.read_directory(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"])
    assert {r.id for r in again.collect()} == {r.id for r in rows}
    with pytest.raises(ValueError):
        tabular.normalised_header(["A b", " a B "])
    (tmp_path / "c.json").write_text('{"a": 1, "zzz": 2}\nbroken\n{"a": 3}\n')
    assert [r.a for r in tabular.read_json_lines(spark, f"file://{tmp_path}/c.json", "a int").collect()] == [1, 3]


def test_dynamic_columns(spark):
    rows = spark.createDataFrame([(0, {"z": "1", "id": "a"}), (1, {"z": "", "y": "t"}), (2, {"y": None})], "pos int, attrs map<string,string>")
    wide = tabular.spread(rows, "attrs", "pos", ["id"])
    assert wide.columns == ["pos", "id", "z", "y"]
    assert [tuple(r)[1:] for r in wide.orderBy("pos").collect()] == [("a", "1", "NONE"), ("NONE", "0", "t"), ("NONE", "0", "NONE")]


def test_versioned_tables(spark, tmp_path):
    table = state.VersionedTable(spark, f"file://{tmp_path}/t")
    one = table.write(spark.range(3).toDF("k").withColumn("ts", F.lit(1)), "first/..//x")
    state.upsert(table, spark.createDataFrame([(1, 2), (9, 3)], "k long, ts int"), ["k"], "ts", cap=3)
    assert {(r.k, r.ts) for r in table.read().collect()} >= {(9, 3), (1, 2)} and table.read().count() == 3
    with pytest.raises(ValueError):
        table.delete(one)
    table.activate(one)
    assert table.read().count() == 3 and table.versions()[0]["id"] == one


def test_generated_rows_are_those_of_any_partitioning(spark):
    a = tabular.generate(spark, 4000).collect()
    assert tabular.generate(spark, 4000).repartition(7).exceptAll(spark.createDataFrame(a, tabular.generate(spark, 1).schema)).isEmpty()
    assert len(a[0]) == 20 and [tuple(r) for r in a[:50]] == [tuple(r) for r in tabular.generate(spark, 4000).coalesce(2).where("pos < 50").orderBy("pos").collect()]
    assert tabular.generate(spark, 4000, seed=7).where("pos < 50").orderBy("pos").collect() != a[:50]


def test_generated_rows_have_the_moments_of_their_laws(spark):
    df = tabular.generate(spark, 40_000)
    m = df.agg(F.avg("rider_rate"), F.var_samp("rider_rate"), F.avg("horse_age"), F.avg("won"), F.corr("horse_rate", "won"), F.avg((F.col("level") == "Club").cast("int")), F.corr("rk", "won"), F.min("rk"), F.max(F.col("rk") - F.col("starters"))).first()
    assert abs(m[0] - 0.4) < 0.01 and abs(m[1] - 0.04) < 0.003  # beta(2, 3), hardly touched by its limits
    assert abs(m[2] - 12) < 0.15 and 0.2 < m[3] < 0.8 and m[4] > 0.2 and abs(m[5] - 0.35) < 0.01 and m[6] < -0.2 and m[7] == 1 and m[8] == 0
    for c in ("breed", "rider_age", "horse_rate"):
        assert abs(df.where(F.col(c).isNull()).count() / 40_000 - 0.05) < 0.006
    assert df.where("sex IS NULL OR level IS NULL OR club IS NULL OR rk IS NULL").isEmpty()


def test_serving_tables_have_keys_of_names(spark, tmp_path):
    (tmp_path / "s.csv").write_text("cheval;cavalier\n éole ;Ann\n;\n")
    rows = tabular.read_serving(spark, f"file://{tmp_path}/s.csv", {"cheval": "horse_key", "cavalier": "rider_key"}).collect()
    assert (rows[0].horse_key, rows[0].rider_key) == ("ÉOLE", "ANN") and len(rows) == 2


def test_windows_1252_files_keep_their_signs(spark, tmp_path):
    signs = bytes(b for b in range(0x80, 0x100) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)).decode("cp1252")
    assert len(tabular.WINDOWS_SIGNS) == 32 and sum(ord(c) > 0xFF for c in tabular.WINDOWS_SIGNS) == 27
    body = f"cheval;discipline;cavalier\nL’Été – œuvre €;CSO;{signs}\nPlain;CSO;x\n"
    (tmp_path / "w.csv").write_bytes(body.encode("cp1252"))
    (tmp_path / "u.csv").write_bytes(body.encode("utf-8-sig"))
    for name in ("w.csv", "u.csv"):
        rows = tabular.read_history_file(spark, f"file://{tmp_path}/{name}").orderBy("line").collect()
        assert [(r.horse, r.family) for r in rows] == [("L’Été – œuvre €", "CSO"), ("Plain", "CSO")] and rows[0].rider == signs


def test_models_learn_and_report(spark):
    rows = spark.range(600).select((F.col("id") % 10).cast("double").alias("x"), F.rand(1).alias("y"), (F.col("id") % 10 >= 6).cast("int").alias("won"))
    for name in ("tree", "logistic"):
        model = learning.fit(rows, ["x", "y"], name, rounds=20, trees=20)
        assert learning.evaluate(learning.score(model, rows)).auc > 0.95
        assert learning.importances(model, ["x", "y"])[0][0] == "x"
    curve = learning.curve_points(learning.score(model, rows)).agg(F.sum("area"), F.max("tpr"), F.max("fpr")).first()
    assert abs(curve[0] - learning.evaluate(learning.score(model, rows)).auc) < 1e-9 and curve[1] == curve[2] == 1


def test_language_is_told_from_the_whole_text(spark):
    junk = "0123456789 " * 400
    rows = [(1, junk + "the cat and the dog " * 20, "en"), (2, "der und das " * 20 + junk, "de"), (3, "el y que " * 40 + "x " * 2000 + "the and of " * 200, "en"), (4, junk, ""), (5, None, "")]
    df = spark.createDataFrame(rows, "id long, text string, want string")
    tell = lambda d: {r.id: r.language for r in d.select("id", documents.detected_language().alias("language")).collect()}
    assert tell(documents.stopword_scores(df)) == {i: want for i, _, want in rows}
    assert tell(documents.stopword_scores(df, sample=3000))[1] == ""


def test_html_rows(spark):
    html_rows.register(spark)
    page = "<table><tr><th>Clt</th><th>Nom</th></tr><tr><td>1<sup>er</sup></td><td>A &amp; B</td><td>x</td></tr></table><form><input name=q value=1><select name=s><option value=a>A</select></form><img data-src=i.png srcset='a.png 1x, b.png 2x'><span class='label'><strong>Robe :</strong> Bai</span>"
    spark.createDataFrame([(page,), ("",), (None,)], "html string").createOrReplaceTempView("t")
    assert [r.cells for r in spark.sql("SELECT x.* FROM t, LATERAL html_tables(html) x").collect()] == ['{"Clt": "1 er", "Nom": "A & B", "col_2": "x"}']
    assert spark.sql("SELECT x.* FROM t, LATERAL html_forms(html) x").count() == 2
    assert {r.src for r in spark.sql("SELECT x.* FROM t, LATERAL html_media(html) x").collect()} == {"i.png", "a.png", "b.png"}
    assert ("Robe", "Bai", "") in {tuple(r) for r in spark.sql("SELECT x.* FROM t, LATERAL html_leaves(html, 9) x").collect()}
    assert html_rows.fingerprint("<body><p class=a>1</p></body>") == html_rows.fingerprint("<body><p class=a>other</p></body>") != html_rows.fingerprint("<body><p>1</p></body>")


def test_row_generators_and_languages_of_all_pages(spark, tmp_path):
    from turfline.plans import registry

    prose = "<p>" + "the cat is in the house and it is not on the table " * 4 + "</p>"
    deep = "<div>" * 300 + "<u>deepest</u>" + "</div>" * 300
    pages = [
        (1, "<meta name='language' content='fr-FR'><table><tr><th>A</th></tr><tr><td>1</td></tr></table>" + prose, "fr-FR", "fr"),
        (2, '<meta content="de_DE" property="og:locale"><form><input name=q></form><img data-src=i.png>', "de_DE", "de"),
        (3, f"<html translate=no><script>le la les de des du et</script>{prose}{deep}", "", "en"),
        (4, None, "", ""),
    ]
    spark.createDataFrame(pages, "page_id long, html string, d string, l string").drop("d", "l").withColumn("url", F.lit("u")).write.parquet(f"{tmp_path}/pages.parquet")
    assert {tuple(r) for r in registry.QUERIES["page_language"](spark, str(tmp_path)).collect()} == {(i, d, lang) for i, _, d, lang in pages}
    rows = {tuple(r) for r in registry.QUERIES["html_rows_of_pages"](spark, str(tmp_path)).collect()}
    assert (1, "html_tables", '{"table":0,"row":0,"cells":"{\\"A\\": \\"1\\"}"}') in rows
    assert (2, "html_forms", '{"form":0,"field":"input","type":"text","name":"q","value":""}') in rows
    assert (2, "html_media", '{"kind":"img","src":"i.png"}') in rows
    assert (3, "html_leaves", '{"column":"u","value":"deepest","language":""}') in rows


def test_stream_breaker_matches_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "u", start + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 29, 60, 61, 62, 200])]
    events = spark.createDataFrame(rows, "event_id long, user string, ts timestamp")
    batch = [r.event_id for r in breaker.rolling_trips(events, F.lit(True), "user", 30, 3).where("trips").orderBy("event_id").collect()]
    assert batch == [2, 5]
    for k in range(2):
        events.where(F.col("event_id") % 2 == k if k else F.col("event_id") < 0).write.mode("append").parquet(f"{tmp_path}/in")
    events.write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = breaker.stream_trips(stream, "user", 30, 3).writeStream.format("memory").queryName("trips").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        query.processAllAvailable()
        assert spark.sql("SELECT count(*) FROM trips").first()[0] == 2
    finally:
        query.stop()


def test_every_query_has_a_docstring_and_a_plan(spark):
    from turfline.plans import registry

    assert len(registry.QUERIES) > 55 and set(registry.ORACLES) <= set(registry.QUERIES)
    assert all(q.__doc__ for q in registry.QUERIES.values())


def test_combinations_are_never_shuffled(spark):
    from turfline.plans import registry

    plan = registry.QUERIES["combo_means"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "posexplode" in line)
    assert not any(word in line for line in plan[:at] for word in ("Join", "Aggregate", "Window", "Repartition"))
    assert any("RepartitionByExpression" in line for line in plan[at : at + 3])
