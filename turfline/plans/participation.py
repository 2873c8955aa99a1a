"""Queries of assembly and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..operators import explore, features, learning, relational
from .bindings import FACT, ORDER_SQL, participations, table, total_order
from .define import query


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(CAST(o_custkey AS VARCHAR), 'NONE') AS rider,
       coalesce(o_orderpriority, 'NONE') AS level, coalesce(nullif(trim(p_type), ''), 'NONE') AS family
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey"""
)
def participation_fact(spark: SparkSession, d: str) -> DataFrame:
    """Entries with their round and card looked up; the last duplicate wins, misses are NONE."""
    entries = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority", "o_orderdate")
    cards = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name")
    rows = relational.lookup(entries, orders, "l_orderkey", [F.desc("o_orderdate"), F.desc("o_custkey")])
    rows = relational.lookup(rows, cards, "l_partkey", [F.desc("p_name")])
    return rows.select("l_orderkey", "l_linenumber", t.first_value(F.col("o_custkey").cast("string")).alias("rider"), t.first_value(F.col("o_orderpriority")).alias("level"), t.first_value(F.col("p_type")).alias("family"))


@query(
    """SELECT c_custkey, coalesce(n_name, 'NONE') AS nation, coalesce(r_name, 'NONE') AS region, 'NONE' AS result,
       '/entries/' || c_custkey AS url, '2026-01-01' AS event_date
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def future_fact(spark: SparkSession, d: str) -> DataFrame:
    """The same assembly for events to come: no results, but url and date."""
    entries = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, d, "nation")
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    rows = relational.lookup(relational.lookup(entries, nation, "n_nationkey", [F.desc("n_name")]), region, "n_regionkey", [F.desc("r_name")])
    return rows.select("c_custkey", t.first_value(F.col("n_name")).alias("nation"), t.first_value(F.col("r_name")).alias("region"), F.lit(t.MISSING).alias("result"), F.concat(F.lit("/entries/"), F.col("c_custkey")).alias("url"), F.lit("2026-01-01").alias("event_date"))


_LABELS = "SELECT p_partkey, p_type || ' ' || (p_size * 5) || CASE p_partkey % 3 WHEN 0 THEN ' cm' WHEN 1 THEN ' CM (+2)' ELSE '' END AS label FROM part"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("p_partkey") % 3 == 0, " cm").when(F.col("p_partkey") % 3 == 1, " CM (+2)").otherwise("")
    return table(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit(" "), (F.col("p_size") * 5).cast("string"), end).alias("label"))


@query(
    rf"""WITH x AS ({_LABELS})
SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(label, '(?i)(\d+)\s*cm', 1) AS INTEGER), 0) AS height,
       coalesce(nullif(trim(regexp_replace(trim(regexp_replace(trim(label), '\d+\s*cm.*', '')), '\s*\(\+\d+\).*', '')), ''), 'Autre') AS family
FROM x"""
)
def height_and_family(spark: SparkSession, d: str) -> DataFrame:
    """Height and family out of an event label; the family keeps an upper-case CM."""
    return _labels(spark, d).select("p_partkey", t.height_cm(F.col("label")).alias("height"), t.event_family(F.col("label")).alias("family"))


_EVENTS = ["Elite GP", "Club 2 Grand Prix", "Poney 3 vitesse", "Championnat equipe", "As Poney TREC", "Circuit Reg Mania", "Coupe mixte", "Promotion", "Cadet TDA", "Balade"]


def _cascade_sql(x: str, cascade: list, default: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + f" THEN '{v}'" for words, v in cascade)
    return f"CASE {arms} ELSE '{default}' END"


@query(
    f"""WITH x AS (SELECT o_orderkey, [{", ".join(f"'{e}'" for e in _EVENTS)}][CAST(o_orderkey % 10 AS INTEGER) + 1] || ' ' || o_orderpriority AS label,
   CASE o_orderkey % 3 WHEN 0 THEN ' individuel ' WHEN 1 THEN 'Equipe' END AS team FROM orders),
y AS (SELECT *, {_cascade_sql("label", t.LEVEL_KEYWORDS, t.DEFAULT_LEVEL)} AS level, {_cascade_sql("label", t.KIND_KEYWORDS, t.DEFAULT_KIND)} AS kind FROM x)
SELECT o_orderkey, level, kind, CASE WHEN upper(trim(team)) = 'INDIVIDUEL' THEN 0 ELSE 1 END AS is_team,
       CASE {" ".join(f"WHEN level = '{k}' THEN {v}" for k, v in t.LEVEL_ORDINALS.items())} ELSE 3 END AS level_ordinal FROM y"""
)
def keyword_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level, kind, team flag and level ordinal by keyword cascades."""
    names = F.array(*[F.lit(e) for e in _EVENTS])
    label = F.concat(F.element_at(names, (F.col("o_orderkey") % 10 + 1).cast("int")), F.lit(" "), F.col("o_orderpriority"))
    team = F.when(F.col("o_orderkey") % 3 == 0, " individuel ").when(F.col("o_orderkey") % 3 == 1, "Equipe")
    rows = table(spark, d, "orders").select("o_orderkey", label.alias("label"), team.alias("team"))
    level = t.event_level(F.col("label"))
    return rows.select("o_orderkey", level.alias("level"), t.event_kind(F.col("label")).alias("kind"), t.is_team(F.col("team")).alias("is_team"), t.level_ordinal(level).alias("level_ordinal"))


@query(
    """WITH f AS (SELECT user_id, min(event_id) AS p FROM events GROUP BY user_id)
SELECT event_id, user_id, entity_id FROM events JOIN (SELECT user_id, row_number() OVER (ORDER BY p, user_id)::INTEGER AS entity_id FROM f) USING (user_id)"""
)
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids in order of first appearance."""
    events = table(spark, d, "events").select("event_id", "user_id")
    ids = relational.surrogate_ids(events, "user_id", "event_id", "entity_id")
    return events.join(ids, "user_id").select("event_id", "user_id", "entity_id")


@query(f"WITH {FACT} SELECT contest, round, horse, rk, pts, won, CASE WHEN contest IS NOT NULL AND round IS NOT NULL THEN count(rk) OVER (PARTITION BY contest, round) END AS field_size FROM fact")
def outcome_label(spark: SparkSession, d: str) -> DataFrame:
    """The target, and how many ran in the same round."""
    return features.field_size(participations(spark, d), ["contest", "round"], "rk", "field_size").select("contest", "round", "horse", "rk", "pts", "won", "field_size")


_RATES = ", ".join(
    f"round(coalesce(avg(won) OVER (PARTITION BY {k} ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.3), 6) AS {k}_rate, "
    f"(row_number() OVER (PARTITION BY {k} ORDER BY {ORDER_SQL}) - 1)::INTEGER AS {k}_starts"
    for k in ("horse", "rider", "club")
)


@query(f"WITH {FACT} SELECT contest, round, horse, rider, club, won, {_RATES} FROM fact")
def prior_rates(spark: SparkSession, d: str) -> DataFrame:
    """Strictly-prior success rates and starts of horse, rider and club."""
    rows = features.prior_rates(participations(spark, d), {"horse": "horse", "rider": "rider", "club": "club"}, "won", total_order())
    rates = [x for k in ("horse", "rider", "club") for x in (F.round(f"{k}_rate", 6).alias(f"{k}_rate"), F.col(f"{k}_starts"))]
    return rows.select("contest", "round", "horse", "rider", "club", "won", *rates)


_PRIOR = ", ".join(
    f"coalesce(avg(won) OVER (PARTITION BY {k} ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.3) AS {k}_rate, row_number() OVER (PARTITION BY {k} ORDER BY {ORDER_SQL}) - 1 AS {k}_starts"
    for k in ("horse", "rider")
)


@query(
    f"""WITH {FACT}, r AS (SELECT *, {_PRIOR} FROM fact)
SELECT contest, round, horse, rider, round(horse_rate * rider_rate, 6) AS synergy, round(horse_starts / (height / 10 + 1), 6) AS experience,
       round(horse_rate * level, 6) AS horse_x_level, round(horse_rate * (height / 100), 6) AS horse_x_height,
       round(rider_rate * level, 6) AS rider_x_level, round(rider_rate * (height / 100), 6) AS rider_x_height,
       round(horse_rate * rider_rate * level, 6) AS synergy_x_level
FROM r WHERE rk > 5"""
)
def interaction_features(spark: SparkSession, d: str) -> DataFrame:
    """Products and ratios; the rank filter comes after the history, never before."""
    rows = features.prior_rates(participations(spark, d), {"horse": "horse", "rider": "rider"}, "won", total_order())
    rows = features.interactions(rows).where("rk > 5")
    names = ["synergy", "experience", "horse_x_level", "horse_x_height", "rider_x_level", "rider_x_height", "synergy_x_level"]
    return rows.select("contest", "round", "horse", "rider", *[F.round(c, 6).alias(c) for c in names])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN q > 0 AND q <= 10 THEN 'small' WHEN q > 10 AND q <= 25 THEN 'medium' WHEN q > 25 AND q <= 50 THEN 'large' WHEN q > 50 AND q <= 999 THEN 'xlarge' ELSE 'nan' END AS density FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem)")
def field_size_bins(spark: SparkSession, d: str) -> DataFrame:
    """Field sizes in right-closed bins."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.field_size_bin(F.col("l_quantity").cast("int")).alias("density"))


@query("SELECT lower(trim(p_type)) AS value, (row_number() OVER (ORDER BY lower(trim(p_type))) - 1)::INTEGER AS code FROM (SELECT DISTINCT lower(trim(p_type)) AS p_type FROM part)")
def label_codes(spark: SparkSession, d: str) -> DataFrame:
    """Label codes in sorted order."""
    return explore.label_codes(table(spark, d, "part"), "p_type")


@query(f"WITH {FACT} SELECT contest, round, horse, won, row_number() OVER (PARTITION BY won ORDER BY md5('42:' || contest || ':' || round || ':' || horse), {ORDER_SQL}) * 5 <= count(*) OVER (PARTITION BY won) AS is_test FROM fact")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of every class as test rows, by seeded hash."""
    # Rows of one hash go by their place in the contest, which stands for all columns that tell rows apart.
    place = F.row_number().over(Window.partitionBy("contest").orderBy(*total_order()))
    rows = participations(spark, d).select("contest", "round", "horse", "won", F.unhex(F.md5(F.concat_ws(":", F.lit("42"), "contest", "round", "horse"))).alias("_key"), place.alias("_nth"))
    order = F.struct("_key", "contest", "_nth")
    return explore.stratified_test(rows, "won", order).select("contest", "round", "horse", "won", "is_test")


@query(f"WITH {FACT}, x AS (SELECT contest, round, CASE WHEN rk % 7 = 0 THEN NULL ELSE CAST(height AS DOUBLE) END AS height, CASE WHEN rk % 11 = 0 THEN NULL ELSE CAST(pts AS DOUBLE) END AS points FROM fact) SELECT contest, round, coalesce(height, (SELECT quantile_cont(height, 0.5) FROM x)) AS height, coalesce(points, (SELECT quantile_cont(points, 0.5) FROM x)) AS points FROM x")
def median_impute(spark: SparkSession, d: str) -> DataFrame:
    """Nulls to exact medians."""
    x = participations(spark, d).select("contest", "round", F.when(F.col("rk") % 7 != 0, F.col("height").cast("double")).alias("height"), F.when(F.col("rk") % 11 != 0, F.col("pts").cast("double")).alias("points"))
    return explore.impute_medians(x, ["height", "points"]).select("contest", "round", "height", "points")


_SCORED = f"""{FACT}, scored AS (
  SELECT won, round(coalesce(avg(won) OVER (PARTITION BY rider ORDER BY {ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.3), 4) AS proba FROM fact),
c AS (SELECT proba, sum(won)::BIGINT AS p, count(*) - sum(won)::BIGINT AS q FROM scored GROUP BY proba),
k AS (SELECT proba, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER w - p AS above, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM c WINDOW w AS (ORDER BY proba DESC))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """A rider's prior rate as a score of winning."""
    rows = features.prior_rates(participations(spark, d), {"rider": "rider"}, "won", total_order())
    return rows.select("won", F.round("rider_rate", 4).alias("proba")).withColumn("prediction", (F.col("proba") >= 0.3).cast("int"))


@query(f"WITH {_SCORED} SELECT proba AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / np, 6) AS tpr, round(fp / nq, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM k")
def score_curves(spark: SparkSession, d: str) -> DataFrame:
    """Exact ROC and precision-recall curves of a prior rate, ties as one step."""
    rows = learning.curve_points(_scored(spark, d))
    return rows.select("threshold", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "precision")])


@query(
    f"""WITH {_SCORED}, m AS (SELECT won AS actual, (proba >= 0.3)::INTEGER AS predicted FROM scored),
a AS (SELECT round(sum(q * (above + tp)) / (2 * any_value(np) * any_value(nq)), 6) AS auc FROM k)
SELECT x.class, round(count(*) FILTER (actual = x.class AND predicted = x.class) / count(*) FILTER (predicted = x.class), 6) AS precision,
       round(count(*) FILTER (actual = x.class AND predicted = x.class) / count(*) FILTER (actual = x.class), 6) AS recall,
       round(2 * count(*) FILTER (actual = x.class AND predicted = x.class) / (count(*) FILTER (predicted = x.class) + count(*) FILTER (actual = x.class)), 6) AS f1,
       count(*) FILTER (actual = x.class) AS support, round(count(*) FILTER (actual = predicted) / count(*), 6) AS accuracy, any_value(auc) AS auc
FROM m, (SELECT unnest([0, 1]) AS class) x, a GROUP BY x.class"""
)
def score_report(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and the exact area under the curve."""
    rows = learning.classification_report(_scored(spark, d))
    return rows.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "auc")])


@query(f"WITH {_SCORED} SELECT a AS actual, p AS predicted, count(*) FILTER (won = a AND (proba >= 0.3)::INTEGER = p) AS n FROM scored, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS p) GROUP BY a, p")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Actual against predicted, all four cells."""
    return learning.confusion(_scored(spark, d))
