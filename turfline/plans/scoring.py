"""Queries of predictions: narrowing, families, features, families and combinations of a pair, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import features, profiles, scoring
from ..staging import stage
from .bindings import FACT, TIME_ORDER_SQL, participations, time_order
from .define import query

#: Results before this day are history; all others are requests. Rates go by time, so none of history counts a result of a later day.
CUT = "2001-05-01"
_KEYS = {"horse": "horse", "rider": "rider", "club": "club"}
_CATEGORY = {"sex": "job", "coat": "team", "size": "cast(round AS string)", "kind": "concat(job, team)"}
_HISTORY = ("horse", "rider", "family", "height", "level", "won", "rk", "pts", "horse_rate", "horse_starts", "rider_rate", "rider_starts", "club_rate", "field", "team", *_CATEGORY)
_RATE = "round(100 * (0.5 * horse_rate + 0.3 * rider_rate + 0.2 * club_rate), 6)"

_HISTORY_SQL = f"""{FACT},
p AS (SELECT *, {", ".join(f"coalesce(avg(won) OVER (PARTITION BY {k} ORDER BY {TIME_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.3) AS {k}_rate, row_number() OVER (PARTITION BY {k} ORDER BY {TIME_ORDER_SQL}) - 1 AS {k}_starts" for k in _KEYS)},
             count(*) OVER (PARTITION BY contest) AS field FROM fact),
h AS (SELECT horse, rider, family, height, level, won, rk, pts, horse_rate, horse_starts, rider_rate, rider_starts, club_rate, field,
             CASE WHEN team = 'O' THEN 1 ELSE 0 END AS team, job AS sex, team AS coat, round::VARCHAR AS size, job || team AS kind
      FROM p WHERE contest_time < TIMESTAMP '{CUT}'),
q AS (SELECT DISTINCT horse, rider, CASE WHEN horse % 7 = 0 THEN 'UNKNOWN' ELSE family END AS family,
             CASE WHEN horse % 3 = 0 THEN NULL ELSE height END AS height, CASE WHEN rider % 2 = 0 THEN NULL ELSE level END AS level
      FROM fact WHERE contest_time >= TIMESTAMP '{CUT}')"""


#: What requests ask for, of the later rows.
_ASKED = ("horse", "rider", "family", "height", "level")


def _contests(spark: SparkSession, d: str, columns: tuple[str, ...]) -> DataFrame:
    """Participations of all days with what these columns of history need; staged, so that the shuffles that join them go and hot keys, rates and requests read few columns.

    A row's place in its contest stands for the columns that only order rows.
    """
    rows, contest = participations(spark, d), Window.partitionBy("contest")
    keys = _rated(columns)
    rates = [f"{k}_{x}" for k in keys for x in ("rate", "starts")]
    sources = {"sex": ("job",), "coat": ("team",), "size": ("round",), "kind": ("job", "team")}
    needs = ["contest_time", *_ASKED, *[x for c in columns if c not in rates for x in sources.get(c, (c,))]]
    if keys:
        rows = rows.withColumn("_place", F.row_number().over(contest.orderBy(*time_order())))
        needs += ["contest", "_place", "won", *keys]
    if "field" in columns:
        rows = rows.withColumn("field", F.count(F.lit(1)).over(contest))
    return stage(rows.select(*dict.fromkeys(needs)), "contests", free=True)


def _rated(columns: tuple[str, ...]) -> dict[str, str]:
    return {k: k for k in ("rider", "club", "horse") if {f"{k}_rate", f"{k}_starts"} & set(columns)}


def _history_of(rows: DataFrame, columns: tuple[str, ...] = _HISTORY) -> DataFrame:
    """History with these of its columns, of _contests. A reader computes and shuffles only the rates that it reads.

    Rows of a later day, which no rate of history counts, go before the rates. Horses come last, so that their rows lie together.
    """
    keys, day, cut = _rated(columns), F.col("contest_time"), F.lit(CUT).cast("timestamp")
    made = {c: F.expr(e) for c, e in _CATEGORY.items()} | {"team": F.when(F.col("team") == "O", 1).otherwise(0)}
    if keys:
        order = [day.asc_nulls_first(), F.col("contest").asc_nulls_first(), F.col("_place")]
        rows = features.prior_rates(rows.where(day.isNull() | (day < cut)), keys, "won", order)
    return rows.where(day < cut).select(*[made[c].alias(c) if c in made else F.col(c) for c in columns])


def _requests_of(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.col("contest_time") >= F.lit(CUT).cast("timestamp"))
    family = F.when(F.col("horse") % 7 == 0, "UNKNOWN").otherwise(F.col("family"))
    height, level = F.when(F.col("horse") % 3 != 0, F.col("height")), F.when(F.col("rider") % 2 != 0, F.col("level"))
    return rows.select("horse", "rider", family.alias("family"), height.alias("height"), level.alias("level")).distinct()


def _history_rows(spark: SparkSession, d: str, columns: tuple[str, ...]) -> DataFrame:
    return _history_of(_contests(spark, d, columns), columns)


def _history(spark: SparkSession, d: str, columns: tuple[str, ...] = _HISTORY) -> DataFrame:
    return _history_rows(spark, d, columns)


def _history_and_requests(spark: SparkSession, d: str, columns: tuple[str, ...] = _HISTORY) -> tuple[DataFrame, DataFrame]:
    rows = _contests(spark, d, columns)
    return _history_of(rows, columns), _requests_of(rows)


def _proba() -> Column:
    return F.expr(_RATE)


_NARROW_SQL = """SELECT r.horse, r.height, r.level, s AS scope, count(*) AS starts, round(avg(horse_rate), 6) AS horse_rate, max(horse_starts)::BIGINT AS horse_starts
FROM (SELECT r.*, CASE WHEN nh > 0 THEN CASE WHEN nhl > 0 THEN 'height_level' ELSE 'height' END WHEN nl > 0 THEN 'level' ELSE 'all' END AS s
      FROM (SELECT r.horse, r.height, r.level, count(*) FILTER (h.height = r.height) AS nh, count(*) FILTER (h.level = r.level) AS nl,
                   count(*) FILTER (h.height = r.height AND h.level = r.level) AS nhl
            FROM (SELECT DISTINCT horse, height, level FROM q) r JOIN h USING (horse) GROUP BY ALL) r) r
JOIN h ON h.horse = r.horse AND (s NOT LIKE 'height%' OR h.height = r.height) AND (s NOT LIKE '%level' OR h.level = r.level) GROUP BY ALL"""


@query(f"WITH {_HISTORY_SQL} {_NARROW_SQL}")
def exact_narrowing(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a horse at exactly the height, then at exactly the level, where there are any."""
    history, requests = _history_and_requests(spark, d, ("horse", "height", "level", "horse_rate", "horse_starts"))
    found = scoring.narrowed(history, requests, "horse", ("horse_rate",), "horse_starts")
    return found.select("horse", "height", "level", "scope", "starts", F.round("horse_rate", 6).alias("horse_rate"), F.col("horse_starts").cast("bigint").alias("horse_starts"))


def _mode_sql(column: str, keys: str) -> str:
    lead = f"{keys}, " if keys else ""
    return f"SELECT {lead}arg_min({column}, (-n, {column})) AS {column} FROM (SELECT {lead}{column}, count(*) AS n FROM h WHERE {column} IS NOT NULL GROUP BY ALL) {'GROUP BY ALL' if keys else ''}"


_FAMILY_SQL = f"""fk AS (SELECT DISTINCT family FROM h), fh AS ({_mode_sql("family", "horse")}), fa AS ({_mode_sql("family", "")}),
r AS (SELECT q.horse, q.rider, q.family AS given, q.height AS asked_height, q.level AS asked_level, CASE WHEN fk.family IS NOT NULL THEN q.family ELSE coalesce(fh.family, fa.family) END AS family
      FROM q LEFT JOIN fk ON fk.family = q.family LEFT JOIN fh ON fh.horse = q.horse, fa)"""


@query(f"WITH {_HISTORY_SQL}, {_FAMILY_SQL} SELECT horse, rider, given, asked_height AS height, asked_level AS level, family FROM r")
def family_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The family that a request counts in: as given if known, else the horse's usual one, else everyone's."""
    return scoring.resolved_family(*_history_and_requests(spark, d, ("horse", "family"))).select("horse", "rider", "given", "height", "level", "family")


def _portrait_sql(name: str, keys: str) -> str:
    """The CTE of a portrait, whose modes come from one CTE each."""
    modes = ("sex", "coat", "size", "kind", "level")
    using = f"USING ({keys})" if keys else "ON true"
    lead = f"{keys}, " if keys else ""
    parts = [f"{name}_{c} AS ({_mode_sql(c, keys)})" for c in modes]
    joins = " ".join(f"LEFT JOIN {name}_{c} {using}" for c in modes)
    head = f"SELECT {lead}count(*) AS n, quantile_cont(height, 0.5)::DOUBLE AS height, avg(team) AS team, avg(field) AS field, avg(level) AS level_num FROM h {'GROUP BY ALL' if keys else ''}"
    return ", ".join([*parts, f"{name} AS (SELECT g.*, {', '.join(f'{name}_{c}.{c}' for c in modes)} FROM ({head}) g {joins})"])


def _exact_sql(entity: str, extra: str) -> str:
    """Statistics of the rows that exact narrowing leaves, per distinct request of an entity."""
    return f"""e_{entity} AS (SELECT r.{entity}, r.ah, r.al, {extra}, max({entity}_starts) AS starts
FROM (SELECT r.*, CASE WHEN nh > 0 THEN CASE WHEN nhl > 0 THEN 3 ELSE 1 END WHEN nl > 0 THEN 2 ELSE 0 END AS s
      FROM (SELECT r.{entity}, r.ah, r.al, count(*) FILTER (h.height = r.ah) AS nh, count(*) FILTER (h.level = r.al) AS nl, count(*) FILTER (h.height = r.ah AND h.level = r.al) AS nhl
            FROM (SELECT DISTINCT {entity}, asked_height AS ah, asked_level AS al FROM r) r JOIN h USING ({entity}) GROUP BY ALL) r) r
JOIN h ON h.{entity} = r.{entity} AND (s % 2 = 0 OR h.height = r.ah) AND (s < 2 OR h.level = r.al) GROUP BY r.{entity}, r.ah, r.al)"""


_VECTOR_SQL = f"""{_portrait_sql("hf", "horse, family")}, {_portrait_sql("hh", "horse")}, {_portrait_sql("ff", "family")}, {_portrait_sql("aa", "")},
{_exact_sql("horse", "avg(horse_rate) AS rate, avg(club_rate) AS club_rate")}, {_exact_sql("rider", "avg(rider_rate) AS rate")},
hp AS (SELECT horse, avg(pts) AS points FROM h GROUP BY horse),
b AS (SELECT r.*, CASE WHEN hh.n IS NULL THEN CASE WHEN ff.n IS NULL THEN aa ELSE ff END WHEN hf.n >= 2 THEN hf ELSE hh END AS c, aa, eh, er, hp.points AS pts_mean
      FROM r LEFT JOIN (SELECT horse, family, {{}} AS hf, n FROM hf) hf ON hf.horse = r.horse AND hf.family = r.family
      LEFT JOIN (SELECT horse, {{}} AS hh, n FROM hh) hh ON hh.horse = r.horse LEFT JOIN (SELECT family, {{}} AS ff, n FROM ff) ff ON ff.family = r.family
      CROSS JOIN (SELECT {{}} AS aa FROM aa) aa
      LEFT JOIN (SELECT horse, ah, al, {{'rate': rate, 'club_rate': club_rate, 'starts': starts}} AS eh FROM e_horse) e1 ON e1.horse = r.horse AND e1.ah IS NOT DISTINCT FROM r.asked_height AND e1.al IS NOT DISTINCT FROM r.asked_level
      LEFT JOIN (SELECT rider, ah, al, {{'rate': rate, 'starts': starts}} AS er FROM e_rider) e2 ON e2.rider = r.rider AND e2.ah IS NOT DISTINCT FROM r.asked_height AND e2.al IS NOT DISTINCT FROM r.asked_level
      LEFT JOIN hp ON hp.horse = r.horse),
v AS (SELECT horse, rider, given, asked_height, asked_level, family, coalesce(c.sex, 'Hongre') AS sex, coalesce(c.coat, 'Bai') AS coat, coalesce(c.size, aa.size) AS size, coalesce(c.kind, aa.kind) AS kind,
             coalesce(asked_height::DOUBLE, c.height, aa.height) AS height, coalesce(asked_level, c.level, aa.level) AS level, round_even(coalesce(c.team, 0), 0)::INTEGER AS team,
             round_even(coalesce(c.field, aa.field), 0)::INTEGER AS field, coalesce(c.level_num, aa.level_num) AS level_num, coalesce(eh.rate, 0.3) AS horse_rate, coalesce(eh.starts, 0) AS horse_starts,
             coalesce(er.rate, 0.3) AS rider_rate, coalesce(er.starts, 0) AS rider_starts, coalesce(eh.club_rate, 0.3) AS club_rate, coalesce(pts_mean, 0) AS points FROM b)"""
_STRUCT = "{'n': n, 'height': height, 'team': team, 'field': field, 'level_num': level_num, 'sex': sex, 'coat': coat, 'size': size, 'kind': kind, 'level': level}"
_VECTOR_SQL = _VECTOR_SQL.replace("{} AS", _STRUCT + " AS")
_NUMBERS = ("horse_x_level", "horse_x_height", "rider_x_level", "rider_x_height", "synergy_x_level", "horse_rate", "rider_rate", "club_rate", "synergy", "experience", "points", "level_num", "height")


@query(
    f"""WITH {_HISTORY_SQL}, {_FAMILY_SQL}, {_VECTOR_SQL}
SELECT horse, rider, given, asked_height, asked_level, family, sex, coat, size, kind, level, team, field, horse_starts::BIGINT AS horse_starts, rider_starts::BIGINT AS rider_starts, '' AS density,
       round(height + 1e-9, 6) AS height, round(level_num + 1e-9, 6) AS level_num, round(horse_rate + 1e-9, 6) AS horse_rate, round(rider_rate + 1e-9, 6) AS rider_rate, round(club_rate + 1e-9, 6) AS club_rate, round(points + 1e-9, 6) AS points,
       round(horse_rate * rider_rate + 1e-9, 6) AS synergy, round(CASE WHEN height <> 0 THEN horse_starts / (height / 10 + 1) ELSE horse_starts END + 1e-9, 6) AS experience,
       round(horse_rate * level_num + 1e-9, 6) AS horse_x_level, round(horse_rate * height / 100 + 1e-9, 6) AS horse_x_height, round(rider_rate * level_num + 1e-9, 6) AS rider_x_level,
       round(rider_rate * height / 100 + 1e-9, 6) AS rider_x_height, round(horse_rate * rider_rate * level_num + 1e-9, 6) AS synergy_x_level FROM v"""
)
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    """The 24 features of every request; a nudge of 1e-9 keeps ties of the sixth digit from falling either way."""
    rows = scoring.feature_vectors(*_history_and_requests(spark, d))
    plain = [F.col(c).cast("bigint").alias(c) if c.endswith("_starts") else F.col(c) for c in scoring.FEATURES if c not in _NUMBERS]
    return rows.select("horse", "rider", "given", F.col("_asked_height").alias("asked_height"), F.col("_asked_level").alias("asked_level"), *plain, *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in _NUMBERS])


_SCORED_SQL = f"s AS (SELECT *, greatest(0, least(100, round_even({_RATE}, 0)::INTEGER)) AS proba FROM v)"


@query(
    f"""WITH {_HISTORY_SQL}, {_FAMILY_SQL}, {_VECTOR_SQL}, {_SCORED_SQL},
th AS (SELECT horse, count(*) AS n, sum(won) AS w FROM h GROUP BY horse), tr AS (SELECT rider, count(*) AS n, sum(won) AS w FROM h GROUP BY rider), tp AS (SELECT horse, rider, count(*) AS n, sum(won) AS w FROM h GROUP BY ALL)
SELECT s.horse, s.rider, given, family, asked_height, asked_level, proba, coalesce(th.n, 0) AS horse_runs, coalesce(th.w, 0)::BIGINT AS horse_wins, coalesce(tr.n, 0) AS rider_runs, coalesce(tr.w, 0)::BIGINT AS rider_wins,
       coalesce(tp.n, 0) AS pair_runs, coalesce(tp.w, 0)::BIGINT AS pair_wins, th.n IS NULL OR tr.n IS NULL AS cold, greatest(3, least(12, coalesce(th.n, 3)))::BIGINT AS age
FROM s LEFT JOIN th USING (horse) LEFT JOIN tr USING (rider) LEFT JOIN tp ON tp.horse = s.horse AND tp.rider = s.rider"""
)
def pair_prediction(spark: SparkSession, d: str) -> DataFrame:
    """A prediction for every request, with totals of horse, rider and pair."""
    rows = scoring.predictions(*_history_and_requests(spark, d), _proba())
    counts = [F.col(f"{e}_{k}").cast("bigint").alias(f"{e}_{k}") for e in ("horse", "rider", "pair") for k in ("runs", "wins")]
    return rows.select("horse", "rider", "given", "family", F.col("_asked_height").alias("asked_height"), F.col("_asked_level").alias("asked_level"), "proba", *counts, "cold", F.col("age").cast("bigint").alias("age"))


def _fields(history: DataFrame) -> DataFrame:
    counts = history.groupBy("family", "field").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("family").agg(F.percentile("field", F.lit(0.5), F.col("_n")).alias("median_field"))


_FIELDS_SQL = "mf AS (SELECT family, quantile_cont(field, 0.5)::DOUBLE AS median_field FROM h GROUP BY family)"
_MEANS_SQL = """m AS (SELECT s.*, greatest(2, coalesce(trunc(median_field)::INTEGER, 12)) AS nf, a.n AS hn, a.m AS hm, b.n AS rn, b.m AS rm
      FROM s LEFT JOIN mf ON mf.family = s.family LEFT JOIN eh2 a ON {horse} LEFT JOIN er2 b ON {rider}),
k AS (SELECT *, greatest(1, least(nf, round_even((100 - proba) / 100 * (nf - 1), 0)::INTEGER + 1)) AS raw,
             CASE WHEN hm IS NULL THEN rm WHEN rm IS NULL THEN hm ELSE (hm + rm) / 2 END AS past, least(0.7, proba / 100) AS w FROM m),
z AS (SELECT *, CASE WHEN past IS NULL THEN raw ELSE greatest(raw, round_even(past * (1 - w::DOUBLE) + raw * w::DOUBLE, 0)::INTEGER) END AS rank FROM k)"""


@query(
    f"""WITH {_HISTORY_SQL.replace("q AS (", "q0 AS (")},
q AS (SELECT DISTINCT p.horse, p.rider, f.family, NULL::INTEGER AS height, NULL::INTEGER AS level
      FROM (SELECT DISTINCT horse, rider FROM q0 WHERE horse IS NOT NULL AND rider IS NOT NULL) p JOIN (SELECT horse, NULL AS rider, family FROM h UNION SELECT NULL, rider, family FROM h) f ON f.horse = p.horse OR f.rider = p.rider
      WHERE f.family IS NOT NULL),
{_FAMILY_SQL}, {_VECTOR_SQL}, {_SCORED_SQL}, {_FIELDS_SQL},
eh2 AS (SELECT horse, family, count(*) AS n, avg(rk) AS m FROM h GROUP BY ALL), er2 AS (SELECT rider, family, count(*) AS n, avg(rk) AS m FROM h GROUP BY ALL),
{_MEANS_SQL.format(horse="a.horse = s.horse AND a.family = s.family", rider="b.rider = s.rider AND b.family = s.family")}
SELECT horse, rider, family, proba, rank, round(hm, 6) AS horse_mean, round(rm, 6) AS rider_mean, coalesce(hn, 0)::BIGINT AS horse_runs, coalesce(rn, 0)::BIGINT AS rider_runs,
       row_number() OVER (PARTITION BY horse, rider ORDER BY proba DESC, family)::INTEGER AS place FROM z"""
)
def family_predictions(spark: SparkSession, d: str) -> DataFrame:
    """A prediction of every asked pair in each family that either has run in."""
    history, requests = _history_and_requests(spark, d)
    pairs = requests.select("horse", "rider").where("horse IS NOT NULL AND rider IS NOT NULL").distinct()
    rows = scoring.by_family(history, pairs, _fields(history), _proba())
    runs = [F.col(f"{e}_runs").cast("bigint").alias(f"{e}_runs") for e in ("horse", "rider")]
    return rows.select("horse", "rider", "family", "proba", "rank", F.round("horse_mean", 6).alias("horse_mean"), F.round("rider_mean", 6).alias("rider_mean"), *runs, "place")


@query(
    f"""WITH {_HISTORY_SQL.replace("q AS (", "q0 AS (")},
q AS (SELECT DISTINCT p.horse, p.rider, p.family, c.height, c.level FROM (SELECT DISTINCT horse, rider, family, level FROM q0 WHERE horse IS NOT NULL AND rider IS NOT NULL) p
      JOIN (SELECT DISTINCT family, CASE WHEN height > 0 THEN height END AS height, level FROM h) c ON c.family = p.family AND (p.level IS NULL OR p.level = c.level)),
{_FAMILY_SQL}, {_VECTOR_SQL}, {_SCORED_SQL}, {_FIELDS_SQL},
eh2 AS (SELECT horse, family, height, level, count(*) AS n, avg(rk) AS m FROM h GROUP BY ALL), er2 AS (SELECT rider, family, height, level, count(*) AS n, avg(rk) AS m FROM h GROUP BY ALL),
{_MEANS_SQL.format(horse="a.horse = s.horse AND a.family = s.family AND a.height = s.asked_height AND a.level = s.asked_level", rider="b.rider = s.rider AND b.family = s.family AND b.height = s.asked_height AND b.level = s.asked_level")}
SELECT horse, rider, family, asked_height AS height, asked_level AS level, proba, rank, round(hm, 6) AS horse_mean, round(rm, 6) AS rider_mean, coalesce(hn, 0)::BIGINT AS horse_runs, coalesce(rn, 0)::BIGINT AS rider_runs FROM z"""
)
def combo_means(spark: SparkSession, d: str) -> DataFrame:
    """A prediction of every asked pair for each height and level of the family, at the asked level where one is asked."""
    history, requests = _history_and_requests(spark, d)
    asked = requests.where("horse IS NOT NULL AND rider IS NOT NULL").select("horse", "rider", "family", F.lit(None).cast("int").alias("height"), "level").distinct()
    rows = scoring.by_combo(history, asked, _fields(history), _proba())
    runs = [F.col(f"{e}_runs").cast("bigint").alias(f"{e}_runs") for e in ("horse", "rider")]
    return rows.select("horse", "rider", "family", "height", "level", "proba", "rank", F.round("horse_mean", 6).alias("horse_mean"), F.round("rider_mean", 6).alias("rider_mean"), *runs)


@query(
    f"""WITH {_HISTORY_SQL.replace("q AS (", "q0 AS (")}, q AS (SELECT DISTINCT horse, rider, family, NULL::INTEGER AS height, NULL::INTEGER AS level FROM q0),
{_FAMILY_SQL}, {_VECTOR_SQL}, {_SCORED_SQL}
SELECT horse, rider, given, CASE WHEN horse IS NOT NULL AND given IS NOT NULL THEN proba END AS proba,
       CASE WHEN horse IS NULL OR given IS NULL THEN 'inconnu' WHEN horse NOT IN (SELECT horse FROM h WHERE horse IS NOT NULL) OR rider IS NULL OR rider NOT IN (SELECT rider FROM h WHERE rider IS NOT NULL) THEN 'cold-start'
            WHEN proba >= 60 THEN 'favori' WHEN proba >= 35 THEN 'outsider+' ELSE 'outsider' END AS verdict FROM s"""
)
def batch_cold_start(spark: SparkSession, d: str) -> DataFrame:
    """All asked entries scored at once, cold pairs labelled."""
    history, requests = _history_and_requests(spark, d)
    return scoring.batch(history, requests.select("horse", "rider", "family").distinct(), _proba()).select("horse", "rider", "given", "proba", "verdict")
