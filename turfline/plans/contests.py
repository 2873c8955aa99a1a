"""Queries of contests, batches of predictions, descriptive statistics and preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contests, explore, preprocess, profiles
from .bindings import FACT, participations, table
from .define import query


@query(
    f"""WITH {FACT}, x AS (SELECT contest, nullif(family, '') AS family, round::VARCHAR AS round, ship::DATE::VARCHAR AS day FROM fact),
m AS (SELECT contest, arg_min(day, (-n, day)) AS date FROM (SELECT contest, day, count(*) AS n FROM x WHERE day IS NOT NULL GROUP BY ALL) GROUP BY contest)
SELECT contest, array_to_string(list_sort(list(DISTINCT family)), '|') AS disciplines, array_to_string(list_sort(list(DISTINCT round)), '|') AS rounds,
       array_to_string(list_sort(list(DISTINCT day)), '|') AS dates, any_value(date) AS date, count(*) AS entries FROM x JOIN m USING (contest) GROUP BY contest"""
)
def contest_detail(spark: SparkSession, d: str) -> DataFrame:
    """What a contest's page shows: its disciplines, rounds and dates, and the usual date."""
    rows = participations(spark, d).select("contest", "family", F.col("round").cast("string").alias("round"), F.col("ship").cast("date").cast("string").alias("day"))
    out = contests.detail(rows, ["contest"], "family", "round", "day")
    return out.select("contest", *[F.array_join(c, "|").alias(c) for c in ("disciplines", "rounds", "dates")], "date", "entries")


@query(f"WITH {FACT}, g AS (SELECT family, height, count(*) AS n, count(*) FILTER (team = 'O') AS cold, coalesce(round(avg(pts) FILTER (team <> 'O'), 6), -1) AS mean_proba FROM fact GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY mean_proba DESC, family, height)::BIGINT AS place FROM g")
def group_headers(spark: SparkSession, d: str) -> DataFrame:
    """Groups of a history with their counts and mean, in the order of the mean."""
    rows = contests.group_header(participations(spark, d), ["family", "height"], "pts", F.col("team") == "O")
    return explore.with_place(rows, [F.desc("mean_proba"), F.col("family"), F.col("height")], "place")


@query(
    """WITH x AS (SELECT trim(coalesce(p_name, '')) AS horse, 'R' || p_size AS rider, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_brand END AS discipline, p_type AS event,
             CASE p_partkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE floor(p_retailprice / 10)::INTEGER::VARCHAR END AS proba, p_size AS rk, CASE WHEN p_partkey % 4 = 0 THEN 'vu' ELSE '' END AS verdict, p_partkey % 6 = 0 AS cold FROM part),
y AS (SELECT *, greatest(0, least(100, coalesce(TRY_CAST(proba AS DOUBLE), 0)))::INTEGER AS p FROM x WHERE horse <> '' AND discipline <> '')
SELECT '2026-01-01T00:00:00' AS ts, horse, rider, discipline, event, '' AS height, rk::INTEGER AS rank, p AS proba,
       CASE WHEN verdict <> '' THEN verdict WHEN cold THEN 'cold-start' WHEN p >= 60 THEN 'favori' WHEN p >= 35 THEN 'outsider+' ELSE 'outsider' END AS verdict, cold,
       'crawl-predict:demo' AS snapshot, substr(sha1(concat_ws(chr(31), '2026-01-01T00:00:00', horse, rider, discipline, event)), 1, 12) AS id FROM y"""
)
def batch_history(spark: SparkSession, d: str) -> DataFrame:
    """A batch of predictions in the form of the history table."""
    key = F.col("p_partkey")
    proba = F.when(key % 5 == 0, "n/a").when(key % 5 == 1, F.lit(None).cast("string")).otherwise(F.expr("cast(cast(floor(p_retailprice / 10) AS int) AS string)"))
    rows = table(spark, d, "part").select(
        F.col("p_name").alias("horse"),
        F.concat(F.lit("R"), F.col("p_size").cast("string")).alias("rider"),
        F.when(F.col("p_size") % 9 != 0, F.col("p_brand")).otherwise("").alias("discipline"),
        F.col("p_type").alias("event"),
        proba.alias("proba"),
        F.col("p_size").alias("rank"),
        F.when(key % 4 == 0, "vu").otherwise("").alias("verdict"),
        (key % 6 == 0).alias("cold"),
    )
    return contests.batch_rows(rows, "demo", "2026-01-01T00:00:00")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS place FROM events WHERE contains(user_id::VARCHAR, '17') OR contains(lower(event_type), '17') OR contains(lower(coalesce(props, '')), '17')")
def history_newest_rank(spark: SparkSession, d: str) -> DataFrame:
    """Places by time inside a file, after a filter over three fields."""
    hit = contests.matching(table(spark, d, "events"), "17", ["user_id", "event_type", "props"])
    return profiles.ranked_within(hit, ["user_id"], [F.desc("ts"), F.desc("event_id")], "place").select("user_id", "event_id", "place")


@query(f"WITH {FACT} SELECT least(12, greatest(3, rk)) AS category, count(*) AS n, round(avg(won), 6) AS rate FROM fact GROUP BY ALL ORDER BY rate DESC, n DESC, category LIMIT 1000")
def age_rates(spark: SparkSession, d: str) -> DataFrame:
    """Success rate and count per value of an age."""
    rows = participations(spark, d).withColumn("age", F.least(F.lit(12), F.greatest(F.lit(3), F.col("rk"))))
    return explore.category_rates(rows, "age", "won", 1000)


_DESCRIBED = {"height": "number", "pts": "number", "rk": "number", "family": "text", "job": "text"}


@query(
    f"WITH {FACT} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", "
        + (
            f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS least, quantile_cont({c}, 0.25)::DOUBLE AS q25, quantile_cont({c}, 0.5)::DOUBLE AS q50, quantile_cont({c}, 0.75)::DOUBLE AS q75, max({c})::DOUBLE AS most, NULL AS top, NULL::BIGINT AS freq FROM fact"
            if kind == "number"
            else f"NULL AS mean, NULL AS std, NULL AS least, NULL AS q25, NULL AS q50, NULL AS q75, NULL AS most, (SELECT arg_min({c}, (-k, {c})) FROM (SELECT {c}, count(*) AS k FROM fact GROUP BY ALL)) AS top, (SELECT max(k) FROM (SELECT {c}, count(*) AS k FROM fact GROUP BY ALL)) AS freq FROM fact"
        )
        for c, kind in _DESCRIBED.items()
    )
)
def describe_columns(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of numbers and texts side by side."""
    pick = lambda kind: [c for c, k in _DESCRIBED.items() if k == kind]
    out = explore.describe(participations(spark, d), pick("number"), pick("text"))
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    f"WITH {FACT}, c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM fact WHERE {c} IS NOT NULL GROUP BY ALL" for c in ("family", "level", "horse"))
    + ') SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS place FROM c) WHERE place <= 20'
)
def top_values(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most frequent values of some columns."""
    return explore.top_categories(participations(spark, d), ["family", "level", "horse"], 20)


_CORRELATED = ["won", "rk", "pts", "height", "level", "price", "tax"]


@query(f"WITH {FACT} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS other, round(corr(won, {c}), 6) AS r FROM fact" for c in _CORRELATED[1:]) + ") WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY abs(r) DESC, other LIMIT 15")
def strongest_correlations(spark: SparkSession, d: str) -> DataFrame:
    """The columns that go most with success."""
    return explore.strongest(explore.correlations(participations(spark, d), _CORRELATED), "won")


@query(
    f"""WITH {FACT}, x AS (SELECT contest, round, horse, rider, family, job, CASE WHEN rk % 7 = 0 THEN NULL ELSE height END AS height, rk AS field, won, contest_time < TIMESTAMP '1996-06-01' AS past FROM fact),
cf AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT lower(trim(coalesce(family, 'inconnu'))) AS value FROM x WHERE past)),
cj AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT lower(trim(coalesce(job, 'inconnu'))) AS value FROM x WHERE past)),
cd AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT CASE WHEN field > 0 AND field <= 10 THEN 'small' WHEN field > 0 AND field <= 25 THEN 'medium' WHEN field > 0 AND field <= 50 THEN 'large' WHEN field > 0 AND field <= 999 THEN 'xlarge' ELSE 'nan' END AS value FROM x WHERE past))
SELECT contest, round, horse, coalesce(cf.code, 0)::INTEGER AS family, coalesce(cj.code, 0)::INTEGER AS job, coalesce(cd.code, 0)::INTEGER AS density,
       coalesce(height::DOUBLE, (SELECT quantile_cont(height, 0.5) FROM x WHERE past)) AS height, won
FROM x LEFT JOIN cf ON cf.value = lower(trim(coalesce(family, 'inconnu'))) LEFT JOIN cj ON cj.value = lower(trim(coalesce(job, 'inconnu')))
LEFT JOIN cd ON cd.value = CASE WHEN field > 0 AND field <= 10 THEN 'small' WHEN field > 0 AND field <= 25 THEN 'medium' WHEN field > 0 AND field <= 50 THEN 'large' WHEN field > 0 AND field <= 999 THEN 'xlarge' ELSE 'nan' END"""
)
def encoded_features(spark: SparkSession, d: str) -> DataFrame:
    """The preprocessing pipeline fitted on the past and applied to all rows; values never seen take the first class."""
    rows = participations(spark, d).select("contest", "round", "horse", "rider", "family", "job", F.when(F.col("rk") % 7 != 0, F.col("height")).alias("height"), F.col("rk").alias("field"), "won", "contest_time")
    past = F.col("contest_time") < F.lit("1996-06-01").cast("timestamp")
    done, _ = preprocess.preprocess(rows, past, ["family", "job", "density"], ["height"])
    return done.select("contest", "round", "horse", "family", "job", "density", "height", "won")
