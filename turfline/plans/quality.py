"""Queries of cleaning, deduplication, statistics and breakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import explore, relational
from ..streaming import breaker
from .bindings import FACT, participations, table
from .define import query

_SCORES = "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CAST(l_discount AS VARCHAR) WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',5%' WHEN 2 THEN ' ' || CAST(CAST(l_quantity * 3 AS INTEGER) AS VARCHAR) || ' %' ELSE 'n/a' END AS x FROM lineitem"


@query(
    rf"""WITH s AS ({_SCORES}), v AS (SELECT *, TRY_CAST(trim(replace(regexp_replace(trim(x), '%+$', ''), ',', '.')) AS DOUBLE) AS n FROM s)
SELECT l_orderkey, l_linenumber, greatest(0, least(100, CAST(round_even(CASE WHEN n BETWEEN 0 AND 1 THEN n * 100 ELSE n END, 0) AS INTEGER))) + 0 * n AS percent,
       CASE WHEN TRY_CAST(regexp_extract(trim(x), '^(\d{{1,9}})', 1) AS INTEGER) BETWEEN 1 AND 200 THEN TRY_CAST(regexp_extract(trim(x), '^(\d{{1,9}})', 1) AS INTEGER) END::DOUBLE AS bounded FROM v"""
)
def score_text_parse(spark: SparkSession, d: str) -> DataFrame:
    """Scores and bounded numbers out of text."""
    li, n = table(spark, d, "lineitem"), F.col("l_linenumber") % 4
    x = F.when(n == 0, F.col("l_discount").cast("string")).when(n == 1, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",5%"))).when(n == 2, F.concat(F.lit(" "), (F.col("l_quantity") * 3).cast("int").cast("string"), F.lit(" %"))).otherwise("n/a")
    rows = li.select("l_orderkey", "l_linenumber", x.alias("x"))
    return rows.select("l_orderkey", "l_linenumber", t.percent_score(F.col("x")).cast("double").alias("percent"), t.bounded_int(F.col("x"), 1, 200).cast("double").alias("bounded"))


_RANKS = ["1 er", "2 e", "3ème", "El.", "12 nd", "abandon", "Forfait", "non-partant", "7", "Cavalier inconnu", " ", "HC"]


@query(
    rf"""WITH x AS (SELECT event_id, [{", ".join(f"'{r}'" for r in _RANKS)}][CAST(event_id % {len(_RANKS)} AS INTEGER) + 1] AS v FROM events),
c AS (SELECT *, CASE WHEN regexp_matches(trim(v), '(?i)^(el|eli|elim|élim|eliminé|éliminé|elimine|disq|dsq|dq|abandon|abd|nc|np)(\.|\s|$)') THEN '-1'
  WHEN regexp_matches(trim(v), '(?i)^\s*\d+\s*(er|ère|ere|re|nd|nde|ème|eme|e)\s*\.?\s*$') THEN regexp_extract(trim(v), '(\d+)', 1) ELSE v END AS place FROM x)
SELECT event_id, place, CASE WHEN trim(place) = '' THEN place WHEN regexp_matches(trim(place), '^-?\d+(\.\d+)?$') THEN trim(place) ELSE '-1' END AS number
FROM c WHERE NOT regexp_matches(trim(v), '(?i)^(non[\s\-]*partant|forfait|hors[\s\-]*concours|fft|hc)\b')"""
)
def ordinal_clean(spark: SparkSession, d: str) -> DataFrame:
    """Places out of text; rows that did not start go."""
    v = F.element_at(F.array(*[F.lit(r) for r in _RANKS]), (F.col("event_id") % len(_RANKS) + 1).cast("int"))
    rows = table(spark, d, "events").select("event_id", v.alias("v")).where(~t.did_not_start(F.col("v")))
    rows = rows.withColumn("place", t.clean_ordinal(F.col("v")))
    return rows.select("event_id", "place", t.ranking_number(F.col("place")).alias("number"))


@query(
    r"""WITH a AS (SELECT event_type, CAST(value AS VARCHAR) AS v FROM events UNION ALL SELECT event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END FROM events UNION ALL SELECT event_type || '_text', event_type FROM events)
SELECT event_type AS name, count(*) FILTER (v IS NULL OR trim(v) = '') AS blanks,
       bool_and(v IS NULL OR trim(v) = '' OR regexp_matches(trim(v), '^-?\d+(\.\d+)?$')) AND count(*) FILTER (v IS NOT NULL AND trim(v) <> '') > 0 AS is_numeric,
       CASE WHEN bool_and(v IS NULL OR trim(v) = '' OR regexp_matches(trim(v), '^-?\d+(\.\d+)?$')) THEN '0' ELSE 'NONE' END AS filler FROM a GROUP BY event_type"""
)
def sentinel_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per dynamic column: blanks, whether all values are numbers, and the filler that follows."""
    ev = table(spark, d, "events")
    rows = ev.select("event_type", F.col("value").cast("string").alias("v"))
    rows = rows.unionAll(ev.select("event_type", F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string"))))
    rows = rows.unionAll(ev.select(F.concat("event_type", F.lit("_text")), "event_type"))
    blank = F.col("v").isNull() | (t.strip(F.col("v")) == "")
    number = F.coalesce(blank, F.lit(False)) | t.strip(F.col("v")).rlike(r"^-?\d+(?:\.\d+)?$")
    all_numbers = F.bool_and(number)
    return rows.groupBy(F.col("event_type").alias("name")).agg(F.count_if(blank).alias("blanks"), (all_numbers & (F.count_if(~blank) > 0)).alias("is_numeric"), F.when(all_numbers, "0").otherwise("NONE").alias("filler"))


@query("SELECT min(event_id) AS event_id, event_type, user_id, props FROM events GROUP BY event_type, user_id, props")
def ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first of rows with equal content, provenance aside."""
    rows = table(spark, d, "events").withColumn("attrs", F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("props"), F.col("props"), F.lit("source_url"), F.col("event_id").cast("string")))
    return relational.dedup_rows(rows, "attrs", "event_id", ["source_url"]).select("event_id", "event_type", "user_id", "props")


@query(
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'NONE' ELSE o_orderpriority END AS a, CASE WHEN o_orderkey % 40 = 1 THEN o_orderstatus END AS b, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS c FROM orders),
p AS (SELECT *, coalesce(upper(trim(a)) NOT IN ('', 'NONE', '-1'), false) AS ha, coalesce(b IS NOT NULL, false) AS hb FROM x),
s AS (SELECT avg(ha::INT) AS pa, avg(hb::INT) AS pb FROM p)
SELECT o_orderkey, a, b, c FROM p, s WHERE NOT (pa >= 0.95 AND NOT ha) AND NOT (pa <= 0.05 AND ha) AND NOT (pb >= 0.95 AND NOT hb) AND NOT (pb <= 0.05 AND hb)"""
)
def uniformise(spark: SparkSession, d: str) -> DataFrame:
    """Rows that look like the majority: every near-universal column, no rare one."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k % 50 == 0, "NONE").otherwise(F.col("o_orderpriority")).alias("a"), F.when(k % 40 == 1, F.col("o_orderstatus")).alias("b"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("c"))
    return explore.uniform_rows(rows, ["a", "b", "c"], {c: t.has_value(F.col(c)) for c in "abc"})


_PROFILED = ["user_id", "event_type", "value"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, round(100 * (count(*) - count({c})) / count(*), 6) AS missing_share, count(DISTINCT {c}) AS n_distinct FROM events" for c in _PROFILED))
def missing_profile(spark: SparkSession, d: str) -> DataFrame:
    """Missing and distinct values per column."""
    return explore.missing_profile(table(spark, d, "events").select(*_PROFILED))


@query(f"WITH {FACT}, x AS (SELECT least(rk, 50)::DOUBLE AS x FROM fact), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x) SELECT least(29, CAST(floor((x - lo) * 30 / (hi - lo)) AS INTEGER)) AS bin, count(*) AS n FROM x, e GROUP BY 1")
def histograms(spark: SparkSession, d: str) -> DataFrame:
    """Thirty bins of ranks clipped at 50."""
    return explore.histogram(participations(spark, d), "rk", 30, 50)


@query(f"WITH {FACT} SELECT family AS category, count(*) AS n, round(avg(won), 6) AS rate FROM fact GROUP BY family ORDER BY rate DESC, n DESC, category LIMIT 15")
def category_success(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen best categories."""
    return explore.category_rates(participations(spark, d), "family", "won", 15)


_CORR = ["rk", "pts", "height", "level", "won"]


@query(f"WITH {FACT} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM fact" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]))
def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise correlations."""
    return explore.correlations(participations(spark, d), _CORR)


@query("WITH h AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error') SELECT event_id, user_id, count(*) OVER w AS recent, count(*) OVER w >= 3 AS trips FROM h WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)")
def error_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Errors of a user within two days before and at each error; three trip the breaker."""
    return breaker.rolling_trips(table(spark, d, "events"), F.col("event_type") == "error", "user_id", 172_800, 3).select("event_id", "user_id", "recent", "trips")


_RUNS = """r AS (SELECT *, event_type <> 'click' AS e, sum(CASE WHEN event_type <> 'click' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
s AS (SELECT *, CASE WHEN e THEN sum(e::INTEGER) OVER (PARTITION BY user_id, island ORDER BY event_id) ELSE 0 END AS run FROM r),
t AS (SELECT user_id, min(event_id) FILTER (run = 10) AS aborted_at FROM s GROUP BY user_id)"""


@query(f"WITH {_RUNS} SELECT user_id, island::BIGINT AS island, count(*) AS length, min(event_id) AS began, max(event_id) AS ended, any_value(aborted_at) AS aborted_at FROM s LEFT JOIN t USING (user_id) WHERE e GROUP BY user_id, island")
def empty_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events without a click, and where the first run of ten would end a user's step."""
    return breaker.streaks(table(spark, d, "events"), F.col("event_type") != "click", "user_id", "event_id", 10)


@query(f"WITH {_RUNS} SELECT event_id, user_id, run::BIGINT AS run FROM s LEFT JOIN t USING (user_id) WHERE aborted_at IS NULL OR event_id <= aborted_at")
def events_until_abort(spark: SparkSession, d: str) -> DataFrame:
    """Events up to a user's first run of ten without a click."""
    return breaker.until_abort(table(spark, d, "events"), F.col("event_type") != "click", "user_id", "event_id", 10).select("event_id", "user_id", "run")


@query("SELECT event_id, event_type FROM events WHERE event_id > 500")
def event_cursor(spark: SparkSession, d: str) -> DataFrame:
    """What follows a poller's cursor."""
    return breaker.after_cursor(table(spark, d, "events"), 500).select("event_id", "event_type")


@query(f"WITH {FACT} SELECT DISTINCT contest, round, horse, rider, rk, height FROM fact WHERE rk >= 0 AND height >= 0 AND horse IS NOT NULL AND family IS NOT NULL")
def clean_rows(spark: SparkSession, d: str) -> DataFrame:
    """Exact duplicates, negative ranks and rows without key gone."""
    rows = participations(spark, d).where("rk >= 0 AND height >= 0 AND horse IS NOT NULL AND family IS NOT NULL")
    return rows.select("contest", "round", "horse", "rider", "rk", "height").dropDuplicates()


@query("SELECT c_custkey, upper(trim(c_name)) AS name, c_mktsegment FROM customer WHERE upper(trim(c_mktsegment)) = 'BUILDING' ORDER BY c_custkey")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Normalised names, and an equality filter on a normalised key."""
    rows = table(spark, d, "customer").where(t.name_key(F.col("c_mktsegment")) == "BUILDING")
    return rows.select("c_custkey", t.name_key(F.col("c_name")).alias("name"), "c_mktsegment").orderBy("c_custkey")


@query("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def job_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the event log."""
    total = F.round(F.sum(F.col("value").cast("decimal(20,4)")).cast("double"), 2)
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), total.alias("total"))
