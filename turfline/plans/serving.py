"""Queries of serving analytics: profiles, cascades, ranks, contests and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import profiles, relational
from .bindings import FACT, NEWEST_SQL, newest_first, participations, table
from .define import query


@query(f"WITH {FACT} SELECT horse, sum(won)::BIGINT AS wins, count(*) AS starts, round(avg(rk), 6) AS mean_rank FROM fact GROUP BY horse")
def entity_totals(spark: SparkSession, d: str) -> DataFrame:
    """Wins, starts and mean rank of every horse."""
    return profiles.totals(participations(spark, d), ["horse"])


@query(f"WITH {FACT}, c AS (SELECT rider, family, count(*) AS n FROM fact WHERE rider IS NOT NULL AND family IS NOT NULL GROUP BY ALL) SELECT rider, arg_min(family, (-n, family)) AS usual_family FROM c GROUP BY rider")
def entity_modes(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent family of every rider, the smallest on ties."""
    return participations(spark, d).where("rider IS NOT NULL AND family IS NOT NULL").groupBy("rider").agg(F.mode("family", True).alias("usual_family"))


@query(f"WITH {FACT}, f AS (SELECT contest, family, count(*) AS n FROM fact GROUP BY ALL) SELECT family, quantile_cont(n, 0.5)::DOUBLE AS median_field FROM f GROUP BY family")
def median_field(spark: SparkSession, d: str) -> DataFrame:
    """Exact median of the number of starters per contest, by family."""
    per = participations(spark, d).groupBy("contest", "family").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("family").agg(F.percentile("n", F.lit(0.5)).alias("median_field"))


@query(f"WITH {FACT} SELECT count(DISTINCT horse) AS horses, count(DISTINCT rider) AS riders, (SELECT count(*) FROM (SELECT DISTINCT horse, rider FROM fact WHERE horse IS NOT NULL AND rider IS NOT NULL)) AS pairs, count(DISTINCT family) AS families, count(*) AS n FROM fact")
def dataset_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """Exact numbers of horses, riders, pairs, families and rows."""
    return participations(spark, d).agg(F.count_distinct("horse").alias("horses"), F.count_distinct("rider").alias("riders"), F.count_distinct("horse", "rider").alias("pairs"), F.count_distinct("family").alias("families"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {FACT}, c AS (SELECT family, level, count(*) AS n FROM fact GROUP BY ALL), h AS (SELECT family, array_to_string(list_sort(list(DISTINCT height)), ',') AS heights FROM fact WHERE height > 0 GROUP BY family) SELECT family, level, n, row_number() OVER (PARTITION BY family ORDER BY n DESC, level)::INTEGER AS place, heights FROM c LEFT JOIN h USING (family)")
def level_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Levels of each family by frequency, with the family's distinct positive heights."""
    rows = participations(spark, d)
    counts = rows.groupBy("family", "level").agg(F.count(F.lit(1)).alias("n"))
    heights = rows.where("height > 0").groupBy("family").agg(F.array_join(F.array_sort(F.collect_set("height")), ",").alias("heights"))
    return profiles.ranked_within(counts, ["family"], [F.desc("n"), F.col("level")], "place").join(heights, "family", "left").select("family", "level", "n", "place", "heights")


_REQUESTS = "SELECT DISTINCT horse, family, (horse % 3 + 1) * 20 AS height, CASE horse % 4 WHEN 0 THEN 8 WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 3 END AS level FROM fact WHERE horse IS NOT NULL AND family IS NOT NULL"


def _requests(rows: DataFrame) -> DataFrame:
    horse = F.col("horse")
    level = F.when(horse % 4 == 0, 8).when(horse % 4 == 1, 6).when(horse % 4 == 2, 5).otherwise(3)
    return rows.where("horse IS NOT NULL AND family IS NOT NULL").select("horse", "family", ((horse % 3 + 1) * 20).alias("height"), level.alias("level")).distinct()


_SCOPES = ["family_height_level", "family_height", "family_level", "family", "all"]
_CONDITIONS = ["h.family = q.family AND h.height = q.height AND h.level = q.level", "h.family = q.family AND h.height = q.height", "h.family = q.family AND h.level = q.level", "h.family = q.family", "true"]


@query(
    f"""WITH {FACT}, q AS ({_REQUESTS}),
a AS (SELECT q.horse, q.family, q.height, q.level, {", ".join(f"count(*) FILTER ({c}) AS n{i}, coalesce(sum(h.won) FILTER ({c}), 0) AS w{i}" for i, c in enumerate(_CONDITIONS))}
      FROM q JOIN fact h USING (horse) GROUP BY ALL),
i AS (SELECT *, coalesce({", ".join(f"CASE WHEN n{i} >= 3 THEN {i} END" for i in range(5))}) AS e,
             coalesce({", ".join(f"CASE WHEN n{i} >= 1 THEN {i} END" for i in range(4, -1, -1))}) AS b FROM a)
SELECT horse, family, height, level, [{", ".join(f"'{s}'" for s in _SCOPES)}][coalesce(e, b) + 1] AS scope,
       [n0, n1, n2, n3, n4][coalesce(e, b) + 1] AS starts, [w0, w1, w2, w3, w4][coalesce(e, b) + 1]::BIGINT AS wins, e IS NULL AS low_data FROM i"""
)
def scope_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest scope with three rows for every horse, else the broadest."""
    rows = participations(spark, d)
    return profiles.cascade(rows, _requests(rows), "horse")


@query(
    f"""WITH {FACT}, q AS (SELECT DISTINCT horse + 500 AS horse, family FROM fact WHERE horse IS NOT NULL),
f AS (SELECT horse, family, count(*) AS n, sum(won) AS w FROM fact GROUP BY ALL), e AS (SELECT horse, count(*) AS n, sum(won) AS w FROM fact GROUP BY ALL),
p AS (SELECT family, count(*) AS n, sum(won) AS w FROM fact GROUP BY ALL), a AS (SELECT count(*) AS n, sum(won) AS w FROM fact)
SELECT q.horse, q.family, CASE WHEN f.n >= 2 THEN 'family' WHEN e.n IS NOT NULL THEN 'entity' WHEN p.n IS NOT NULL THEN 'population_family' ELSE 'population' END AS basis,
       CASE WHEN f.n >= 2 THEN f.n WHEN e.n IS NOT NULL THEN e.n WHEN p.n IS NOT NULL THEN p.n ELSE a.n END AS starts,
       CASE WHEN f.n >= 2 THEN f.w WHEN e.n IS NOT NULL THEN e.w WHEN p.n IS NOT NULL THEN p.w ELSE a.w END::BIGINT AS wins
FROM q LEFT JOIN f ON q.horse = f.horse AND q.family = f.family LEFT JOIN e ON q.horse = e.horse LEFT JOIN p ON q.family = p.family, a"""
)
def history_fallback(spark: SparkSession, d: str) -> DataFrame:
    """History of known and unknown horses: family, then everything, then the population."""
    rows = participations(spark, d)
    asked = rows.where("horse IS NOT NULL").select((F.col("horse") + 500).alias("horse"), "family").distinct()
    return profiles.family_or_all(rows, asked, "horse")


_SCORED = """m AS (SELECT family, quantile_cont(n, 0.5) AS mf FROM (SELECT contest, family, count(*) AS n FROM fact GROUP BY ALL) GROUP BY family),
s AS (SELECT horse, max(family) AS family, 100 * sum(won) // count(*) AS proba, avg(rk) AS mean_rank FROM fact GROUP BY horse),
r AS (SELECT s.*, greatest(2, coalesce(CAST(floor(mf * 20) AS INTEGER), 12)) AS n FROM s LEFT JOIN m USING (family)),
k AS (SELECT *, greatest(1, least(CAST(round_even((100 - proba) / 100 * (n - 1), 0) AS INTEGER) + 1, n)) AS raw FROM r)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = participations(spark, d)
    fields = rows.groupBy("contest", "family").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg((F.percentile("n", F.lit(0.5)) * 20).alias("mf"))
    scores = rows.groupBy("horse").agg(F.max("family").alias("family"), F.expr("100 * sum(won) div count(1)").alias("proba"), F.avg("rk").alias("mean_rank"))
    return scores.join(fields, "family", "left").withColumn("raw", profiles.estimated_rank(F.col("proba"), F.floor("mf")))


@query(f"WITH {FACT}, {_SCORED} SELECT horse, proba::BIGINT AS proba, raw AS rank FROM k")
def rank_from_score(spark: SparkSession, d: str) -> DataFrame:
    """Rank estimate from a score and the median field."""
    return _scored(spark, d).select("horse", "proba", F.col("raw").alias("rank"))


@query(f"WITH {FACT}, {_SCORED} SELECT horse, raw, greatest(raw, CAST(round_even(mean_rank * (1 - least(0.7::DOUBLE, proba / 100)) + raw * least(0.7::DOUBLE, proba / 100), 0) AS INTEGER)) AS rank FROM k")
def blended_rank(spark: SparkSession, d: str) -> DataFrame:
    """The estimate pulled towards the mean past rank."""
    return _scored(spark, d).select("horse", "raw", profiles.blended_rank(F.col("raw"), F.col("proba"), F.col("mean_rank")).alias("rank"))


@query(f"WITH {FACT}, c AS (SELECT DISTINCT family, height, level FROM fact), p AS (SELECT DISTINCT horse, family FROM fact), e AS (SELECT horse, family, height, level, count(*) AS n FROM fact GROUP BY ALL) SELECT p.horse, c.family, c.height, c.level, coalesce(e.n, 0) AS starts FROM p JOIN c USING (family) LEFT JOIN e ON e.horse = p.horse AND e.family = c.family AND e.height = c.height AND e.level = c.level")
def combo_explosion(spark: SparkSession, d: str) -> DataFrame:
    """Every height and level seen in a family, for each horse, with exact-combo history."""
    rows = participations(spark, d)
    combos = rows.select("family", "height", "level").distinct()
    asked = rows.select("horse", "family").distinct()
    exact = rows.groupBy("horse", "family", "height", "level").agg(F.count(F.lit(1)).alias("starts"))
    out = asked.join(combos, "family").join(exact, ["horse", "family", "height", "level"], "left")
    return out.select("horse", "family", "height", "level", F.coalesce("starts", F.lit(0)).alias("starts"))


@query(f"WITH {FACT}, p AS (SELECT DISTINCT horse, rider FROM fact WHERE horse IS NOT NULL AND rider IS NOT NULL) SELECT horse, rider, family FROM p JOIN (SELECT DISTINCT horse, family FROM fact) USING (horse) UNION SELECT horse, rider, family FROM p JOIN (SELECT DISTINCT rider, family FROM fact) USING (rider)")
def discipline_explosion(spark: SparkSession, d: str) -> DataFrame:
    """All families in which a pair's horse or rider has a history."""
    return profiles.pair_families(participations(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R'), l_quantity DESC, l_partkey, l_suppkey, l_shipdate, l_extendedprice)::INTEGER AS predicted_rank, CASE WHEN l_returnflag = 'R' THEN 'cold-start' WHEN l_quantity * 2 >= 60 THEN 'favori' WHEN l_quantity * 2 >= 35 THEN 'outsider+' ELSE 'outsider' END AS verdict FROM lineitem")
def contest_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Predicted rank in each contest, unknown pairs last, and the verdict."""
    rows = table(spark, d, "lineitem").withColumn("cold", F.col("l_returnflag") == "R").withColumn("proba", F.col("l_quantity") * 2)
    order = [F.col("cold"), F.desc("proba"), *[F.col(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]]
    ranked = profiles.ranked_within(rows, ["l_orderkey"], order, "predicted_rank")
    return ranked.select("l_orderkey", "l_linenumber", "l_partkey", "predicted_rank", t.verdict(F.col("proba"), F.col("cold")).alias("verdict"))


@query(f"WITH {FACT}, r AS (SELECT *, row_number() OVER (PARTITION BY horse ORDER BY {NEWEST_SQL})::INTEGER AS age FROM fact) SELECT horse, age, contest, round, family, height, rk FROM r WHERE age <= 30")
def latest_placements(spark: SparkSession, d: str) -> DataFrame:
    """The thirty newest results of every horse."""
    return profiles.latest(participations(spark, d), ["horse"], newest_first(), 30).select("horse", "age", "contest", "round", "family", "height", "rk")


@query(
    f"""WITH {FACT}, r AS (SELECT *, row_number() OVER (PARTITION BY horse ORDER BY {NEWEST_SQL}) AS age FROM fact),
h AS (SELECT horse, sum(won) FILTER (age <= 5) AS rw, count(*) FILTER (age <= 5) AS rn FROM r GROUP BY horse),
p AS (SELECT horse, rider, count(*) AS n, sum(won) AS w FROM fact WHERE job = 'A' GROUP BY ALL),
q AS (SELECT DISTINCT horse, rider FROM fact WHERE rider IS NOT NULL)
SELECT q.horse, q.rider, CASE
  WHEN p.n > 0 THEN 'Duo ' || CASE WHEN p.w / p.n >= 0.5 THEN 'solide' WHEN p.w / p.n >= 0.2 THEN 'irrégulière' ELSE 'fragile' END || ' — ' || p.n || ' sorties communes, ' || p.w || ' réussites. Cheval : ' || rw || '/' || rn || ' sur ses 5 dernières.'
  WHEN rw >= 3 THEN 'En grande forme : ' || rw || ' réussites sur les ' || rn || ' dernières sorties.'
  WHEN rw = 0 THEN 'En manque de résultats : 0 réussite sur les ' || rn || ' dernières sorties.'
  ELSE 'Forme correcte : ' || rw || '/' || rn || ' réussites récentes.' END AS form
FROM q JOIN h USING (horse) LEFT JOIN p ON q.horse = p.horse AND q.rider = p.rider"""
)
def recent_form(spark: SparkSession, d: str) -> DataFrame:
    """A sentence on the form of each pair; pairs are known from file A alone."""
    rows = participations(spark, d)
    recent = profiles.latest(rows, ["horse"], newest_first(), 5).groupBy("horse").agg(F.sum("won").alias("rw"), F.count(F.lit(1)).alias("rn"))
    pairs = rows.where("job = 'A'").groupBy("horse", "rider").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
    asked = rows.where("horse IS NOT NULL AND rider IS NOT NULL").select("horse", "rider").distinct()
    out = asked.join(recent, "horse").join(pairs, ["horse", "rider"], "left")
    return out.select("horse", "rider", profiles.form_sentence(F.coalesce("n", F.lit(0)), F.coalesce("w", F.lit(0)), F.col("rw"), F.col("rn")).alias("form"))


@query(
    f"""WITH {FACT}, c AS (SELECT job, contest, family, count(*) AS n FROM fact GROUP BY ALL),
m AS (SELECT job, contest, arg_min(family, (-n, family)) AS usual_family FROM c GROUP BY ALL)
SELECT job, contest, usual_family, round(avg(pts), 6) AS mean_points, count(DISTINCT round) AS rounds, min(ship)::DATE::VARCHAR AS first_date, count(*) AS entries
FROM fact JOIN m USING (job, contest) GROUP BY ALL"""
)
def contest_summary(spark: SparkSession, d: str) -> DataFrame:
    """One line per job and contest."""
    per = participations(spark, d).groupBy("job", "contest")
    return per.agg(F.mode("family", True).alias("usual_family"), F.round(F.avg("pts"), 6).alias("mean_points"), F.count_distinct("round").alias("rounds"), F.min("ship").cast("date").cast("string").alias("first_date"), F.count(F.lit(1)).alias("entries"))


@query(f"WITH {FACT}, j AS (SELECT contest, job, max(ship) AS done FROM fact GROUP BY ALL) SELECT contest, arg_max(job, (done, job)) AS job FROM j GROUP BY contest")
def newest_job_wins(spark: SparkSession, d: str) -> DataFrame:
    """The job that last finished a contest."""
    jobs = participations(spark, d).groupBy("contest", "job").agg(F.max("ship").alias("done"))
    return jobs.groupBy("contest").agg(F.max_by("job", F.struct("done", "job")).alias("job"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring brand#2') ORDER BY p_partkey LIMIT 100")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred parts whose joined fields hold a text."""
    rows = table(spark, d, "part").where(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("ring brand#2")))
    return rows.orderBy("p_partkey").limit(100).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_name, min(p_partkey) AS first_position FROM part WHERE starts_with(upper(p_name), 'SM') GROUP BY p_name ORDER BY first_position, p_name LIMIT 10")
def prefix_suggest(spark: SparkSession, d: str) -> DataFrame:
    """Up to ten distinct names with a prefix, by first appearance."""
    rows = table(spark, d, "part").where(F.startswith(t.name_key(F.col("p_name")), F.lit("SM")))
    return relational.first_positions(rows, "p_name", "p_partkey").orderBy("first_position", "p_name").limit(10)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE n = 1 ORDER BY ts DESC, event_id DESC LIMIT 5000")
def history_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newest entry per key, capped to the newest 5000."""
    rows = relational.newest(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(5000).select("user_id", "event_type", "event_id", "value")


@query(f"WITH {FACT} SELECT job, count(*) AS n, count(*) FILTER (team = 'O') AS cold, round(avg(pts) FILTER (team <> 'O'), 6) AS mean_points, array_to_string(list_sort(list(DISTINCT family)), ',') AS families FROM fact GROUP BY job")
def history_file_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows, cold starts, mean of the others and families per history file."""
    cold = F.col("team") == "O"
    return participations(spark, d).groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.count_if(cold).alias("cold"), F.round(F.avg(F.when(~cold, F.col("pts"))), 6).alias("mean_points"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id)::INTEGER AS place FROM events WHERE contains(event_type, 'c')")
def history_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank inside a file after the filter."""
    rows = table(spark, d, "events").where(F.contains("event_type", F.lit("c")))
    return profiles.ranked_within(rows, ["user_id"], [F.desc("value"), F.col("ts"), F.col("event_id")], "place").select("user_id", "event_id", "place")


@query("SELECT event_id, ts::VARCHAR AS ts, user_id FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 1000")
def recent_entries(spark: SparkSession, d: str) -> DataFrame:
    """The thousand newest entries."""
    rows = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)
    return rows.select("event_id", F.col("ts").cast("string").alias("ts"), "user_id")


@query("SELECT user_id, CASE WHEN starts < wins THEN wins ELSE starts END AS starts, greatest(3, least(12, CASE WHEN starts = 0 THEN 3 ELSE starts END)) AS age, round(100 * wins / greatest(starts, 1), 2) AS proba FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS starts, count(*) FILTER (event_type = 'error') AS wins FROM events GROUP BY user_id)")
def pseudo_age(spark: SparkSession, d: str) -> DataFrame:
    """Starts never below wins, the pseudo-age, and the share in percent."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("starts"), F.count_if(F.col("event_type") == "error").alias("wins"))
    return rows.select("user_id", F.greatest("starts", "wins").alias("starts"), t.pseudo_age(F.col("starts")).alias("age"), F.round(100 * F.col("wins") / F.greatest(F.col("starts"), F.lit(1)), 2).alias("proba"))


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'predict' END AS use FROM orders")
def past_future_guard(spark: SparkSession, d: str) -> DataFrame:
    """Past contests train, future ones are predicted."""
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "train").otherwise("predict").alias("use"))


@query(f"WITH {FACT} SELECT horse, rider, count(*) AS starts, sum(won)::BIGINT AS wins, round(avg(won), 6) AS rate FROM fact WHERE horse IS NOT NULL AND rider IS NOT NULL GROUP BY ALL")
def batch_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Pair profiles for scoring all entries at once."""
    rows = participations(spark, d).where("horse IS NOT NULL AND rider IS NOT NULL")
    return rows.groupBy("horse", "rider").agg(F.count(F.lit(1)).alias("starts"), F.sum("won").alias("wins"), F.round(F.avg("won"), 6).alias("rate"))
