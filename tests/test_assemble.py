"""The raw fact and the feature table on hand-made rows."""

from pyspark.sql import functions as F

from turfline.operators import assemble

STEP = "pos int, source_url string, href string, attrs map<string,string>"


def test_star_assembly_keeps_every_entry(spark):
    contests = spark.createDataFrame([(0, "cal", "/c1", {"number": "11"}), (1, "cal", "/c1/", {"number": "12"})], STEP)
    rounds = spark.createDataFrame([(0, "/c1#top", "/r1", {"discipline": "CSO 80 cm", "round": "Club 2 Grand Prix"}), (1, "/zz", "/r2", {"discipline": "none"})], STEP)
    entries = spark.createDataFrame(
        [(0, "/r1", "", {"horse": "Éole", "horse_url": "/h1", "rank": "1", "points": "8", "team": "INDIVIDUEL"}), (1, "/r2/", "", {"horse": "Fée", "rank": "-1"}), (2, "/miss", "", {})], STEP
    )
    cards = spark.createDataFrame([(0, "/h1", "", {"coat": "Bai"})], STEP)
    rows = assemble.raw_fact(contests, rounds, entries, cards).orderBy("pos").collect()
    assert [(r.contest_id, r.discipline_raw, r.horse, r.coat) for r in rows] == [("12", "CSO 80 cm", "Éole", "Bai"), ("NONE", "NONE", "Fée", "NONE"), ("NONE", "NONE", "NONE", "NONE")]
    assert assemble.raw_fact(contests, rounds, entries).count() == 3


def test_headers_fill_only_empty_cells(spark):
    rows = spark.createDataFrame([("t", 0, None, "own"), ("t", 1, "Team A", ""), ("t", 2, None, None), ("t", 3, None, "x"), ("t", 4, "Team B", " ")], "t string, pos int, head string, team string")
    got = [r.team for r in assemble.propagated_header(rows, "t", "pos", "head", "team").orderBy("pos").collect()]
    assert got == ["own", "Team A", "Team A", "x", "Team B"]


def raw(spark, rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "pos int, contest_id string, discipline_raw string, round_raw string, rank_raw string, rider string, club string, horse string, points_raw string, team string").withColumns({c: F.lit("NONE") for c in ("coat", "sex", "size", "sire", "dam")})


def test_feature_table(spark):
    df = raw(
        spark,
        [
            ("2", "CSO 80 cm", "Promotion", "1", "ann ", "C1", "eole", "0", "INDIVIDUEL"),
            ("1", "CSO 90 CM", "Club 2 vitesse", "4", "Ann", "C1", "Éole", "8", "x"),
            ("1", "Dressage", None, "-1", "Bob", " C1 ", "EOLE", "abc", None),
            ("NONE", "", "Elite", "NONE", None, "C2", "EOLE", "7.9", ""),
        ],
    )
    rows = {r.pos: r for r in assemble.feature_table(df).collect()}
    assert set(rows) == {0, 1, 3}  # the eliminated row leaves, after it has shaped the histories
    assert rows[3].horse_rate == 0.3 and rows[3].won == 0 and rows[3].rk is None and rows[3].field_size is None and rows[3].density == "nan"
    assert rows[0].horse_starts == 2 and rows[0].horse_rate == 0.0 and rows[0].won == 1 and rows[0].level_name == "Pro" and rows[0].level == 7
    assert rows[1].won == 1 and rows[1].height == 90 and rows[1].family == "CSO 90 CM" and rows[1].kind == "Vitesse" and rows[1].rider_id == rows[0].rider_id == 1
    strict = {r.pos: r for r in assemble.feature_table(df, strict_reference=True).collect()}
    assert strict[0].horse_rate == 0.5 and "pts" not in assemble.feature_table(df, with_points=False).columns
