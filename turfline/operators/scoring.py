"""Predictions for pairs of horse and rider, for all requests at once.

history: horse, rider, family, height, level, won, rk, the strictly-prior horse_rate,
horse_starts, rider_rate, rider_starts and club_rate, pts, field (starters), team (0 or 1) and
the categories sex, coat, size and kind. requests: horse, rider, family and, where asked
for, height and level (null: not asked). History is aggregated by entity before it
meets a request, so a hot horse is a few rows, whatever its number of results.

Defined results: a null horse or rider is unknown; repeated requests are answered each;
averages leave nulls out; modes take the smallest value on ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pseudo_age, verdict
from ..staging import stage
from . import profiles
from .features import FIRST_RATE
from .relational import tasks_for

CATEGORIES = ("sex", "coat", "size", "kind")
#: What an unknown sex and coat count as.
USUAL_SEX, USUAL_COAT = "Hongre", "Bai"


def narrowed(history: DataFrame, requests: DataFrame, entity: str, means: tuple[str, ...], greatest: str) -> DataFrame:
    """Statistics of the entity's rows at exactly the requested height, if there are any, and of these at the level, if there are any.

    One row per distinct (entity, height, level): scope, starts, the means and the greatest `greatest`.
    """
    sums = [x for c in means for x in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))]
    cells = history.groupBy(entity, F.col("height").alias("_h"), F.col("level").alias("_l")).agg(F.count(F.lit(1)).alias("_n"), F.max(greatest).alias("_max"), *sums)
    met = requests.select(entity, "height", "level").distinct().join(cells, entity)
    tall, same = F.col("_h") == F.col("height"), F.col("_l") == F.col("level")
    masks = {"all": F.lit(True), "height": tall, "level": same, "height_level": tall & same}
    out = []
    for name, mask in masks.items():
        out += [F.sum(F.when(mask, F.col("_n"))).alias(f"n_{name}"), F.max(F.when(mask, F.col("_max"))).alias(f"max_{name}")]
        out += [F.sum(F.when(mask, F.col(f"_{k}_{c}"))).alias(f"{k}_{c}_{name}") for c in means for k in "sn"]
    agg = met.groupBy(entity, "height", "level").agg(*out)
    scope = (
        F.when(F.col("n_height").isNotNull(), F.when(F.col("n_height_level").isNotNull(), "height_level").otherwise("height"))
        .when(F.col("n_level").isNotNull(), "level")
        .otherwise("all")
    )
    pick = lambda stem: F.coalesce(*[F.when(F.col("scope") == name, F.col(f"{stem}_{name}")) for name in masks])
    agg = agg.withColumn("scope", scope)
    values = [(pick(f"s_{c}") / F.nullif(pick(f"n_{c}"), F.lit(0))).alias(c) for c in means]
    return agg.select(entity, "height", "level", "scope", pick("n").alias("starts"), *values, pick("max").alias(greatest))


def _join_narrowed(rows: DataFrame, found: DataFrame, entity: str, prefix: str) -> DataFrame:
    named = found.select(*[F.col(c).alias(f"_{prefix}_{c}") for c in found.columns])
    on = F.col(entity) == F.col(f"_{prefix}_{entity}")
    for c in ("height", "level"):
        on = on & F.col(f"_asked_{c}").eqNullSafe(F.col(f"_{prefix}_{c}"))
    return rows.join(named, on, "left")


def resolved_family(history: DataFrame, requests: DataFrame) -> DataFrame:
    """requests with the family that counts: the given one if the history knows it, else the horse's most frequent, else everyone's."""
    known = history.where("family IS NOT NULL").groupBy("family").agg(F.count(F.lit(1)).alias("_known"))
    usual = history.where("family IS NOT NULL").groupBy("horse").agg(F.mode("family", True).alias("_usual"))
    every = history.agg(F.mode("family", True).alias("_every"))  # one row
    rows = requests.withColumnRenamed("family", "given").withColumn("family", F.col("given"))
    rows = rows.join(known, "family", "left").join(usual, "horse", "left").join(F.broadcast(every), how="left")
    family = F.when(F.col("_known").isNotNull(), F.col("given")).otherwise(F.coalesce("_usual", "_every"))
    return rows.withColumn("family", family).drop("_known", "_usual", "_every")


def _portraits(history: DataFrame, keys: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """keys and, as `portrait`, what the history rows of a key say of its horses and contests, with sums of more columns."""
    modes = [F.mode(c, True).alias(c) for c in (*CATEGORIES, "level")]
    means = [F.avg(c).alias(a) for c, a in (("team", "team"), ("field", "field"), ("level", "level_num"), ("pts", "points"))]
    agg = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *modes, F.percentile("height", F.lit(0.5)).alias("height"), *means, *[F.sum(c).alias(f"sum_{c}") for c in sums])
    return agg.select(*keys, F.struct(*[F.col(c) for c in agg.columns if c not in keys]).alias("portrait"))


def _horses(history: DataFrame, n: int, *sums: str) -> DataFrame:
    """horse, `_usual`, its most frequent family, `_h`, its portrait, and `_by`, its portraits by family; staged.

    Portraits are made where all rows of a horse are. A horse of one family has one; the others' rows are read again.
    """
    tasks = tasks_for(history.sparkSession, n)
    columns = dict.fromkeys(["horse", "family", "team", "field", "level", "height", "pts", *CATEGORIES, *sums])
    rows = history.where("horse IS NOT NULL").select(*columns)
    entry = F.when(F.col("family").isNotNull(), F.struct("family", "portrait"))
    most = F.min(F.when(F.col("family").isNotNull(), F.struct((-F.col("portrait.n")).alias("n"), "family")))["family"]
    by = _portraits(rows.repartition(tasks, "horse"), ["horse", "family"], sums).groupBy("horse")
    found = by.agg(most.alias("_usual"), F.max("portrait").alias("_h"), F.count(F.lit(1)).alias("_n"), F.map_from_entries(F.collect_list(entry)).alias("_by"))
    found = stage(found, "horses", free=True, partitions=tasks)
    several = found.where("_n > 1").select("horse")
    if several.isEmpty():
        return found.drop("_n")
    whole = stage(_portraits(rows.join(several, "horse", "left_semi"), ["horse"], sums), "horses-of-families", free=True, partitions=tasks)
    return found.join(whole, "horse", "left").withColumn("_h", F.coalesce("portrait", "_h")).drop("_n", "portrait")


def _families(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`_family` and its portrait `_f`, a row a family; one row of the most frequent family, `_every`, and everyone's portrait, `_a`. Staged.

    Values are counted together before they are counted one by one, so that few rows reach modes and medians.
    """
    kinds, c = dict(history.dtypes), F.col
    numbers = ("level", "height")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    means = {"team": "team", "field": "field", "level": "level_num"}
    held = [x for m in means for x in (F.sum(m).alias(f"s_{m}"), F.count(m).alias(f"n_{m}"))]
    totals = ["n", *[f"{k}_{m}" for m in means for k in "sn"]]
    rows = history.groupBy("family", *CATEGORIES, *numbers).agg(F.count(F.lit(1)).alias("n"), *held)
    values = [(text, number), *[(c(x).cast("string"), number) for x in CATEGORIES], *[(text, c(x).cast("double")) for x in numbers]]
    values = [F.struct(F.lit(i).alias("which"), t.alias("text"), x.alias("number")) for i, (t, x) in enumerate(values)]
    rows = rows.select("family", *totals, F.inline(F.array(*values))).where("which = 0 OR text IS NOT NULL OR number IS NOT NULL")
    counts = stage(rows.groupBy("family", "which", "text", "number").agg(*[F.sum(x).alias(x) for x in totals]), "families", free=True)

    def portraits(*keys: str) -> DataFrame:
        own = counts.groupBy(*keys, "which", "text", "number").agg(*[F.sum(x).alias(x) for x in totals])
        mode = lambda i, of: F.min(F.when(c("which") == i, F.struct((-c("n")).alias("n"), of)))[of]
        modes = [mode(i + 1, "text").cast(kinds[x]).alias(x) for i, x in enumerate(CATEGORIES)]
        at = len(CATEGORIES) + 1
        modes += [mode(at, "number").cast(kinds["level"]).alias("level"), F.percentile(F.when(c("which") == at + 1, c("number")), F.lit(0.5), c("n")).alias("height")]
        whole = lambda x: F.sum(F.when(c("which") == 0, c(x)))
        agg = own.groupBy(*keys).agg(whole("n").alias("n"), *modes, *[(whole(f"s_{m}") / F.nullif(whole(f"n_{m}"), F.lit(0))).alias(a) for m, a in means.items()])
        return agg.select(*keys, F.struct(*[c(x) for x in agg.columns if x not in keys]).alias("portrait"))

    known = portraits("family").where("family IS NOT NULL").select(c("family").alias("_family"), c("portrait").alias("_f"))
    most = known.agg(F.min(F.struct((-c("_f.n")).alias("n"), "_family"))["_family"].alias("_every"))
    return known, most.join(F.broadcast(portraits().select(c("portrait").alias("_a"))))  # one row each


def feature_vectors(history: DataFrame, requests: DataFrame, density: str = "") -> DataFrame:
    """requests with their resolved family and the model's 24 features, under the names of FEATURES.

    Categories, height and team come from the horse's rows in the family if there are two,
    else from all its rows; of an unknown horse from the family's rows, else from all.
    Rates come from the rows at exactly the requested height and level where there are any.
    """
    return _vectors(history, requests, history.count(), density=density).drop("_h")


def _vectors(history: DataFrame, requests: DataFrame, n: int, *sums: str, density: str = "") -> DataFrame:
    """feature_vectors of n rows of history; `_h` has the horse's number of rows and its sums.

    What history says is staged by entity, step by step, so that a step's shuffles are gone before the next one's; requests meet it when it is small.
    """
    tasks = tasks_for(history.sparkSession, n)
    found = lambda entity, means: stage(narrowed(history, requests, entity, means, f"{entity}_starts"), f"narrowed-{entity}", free=True, partitions=tasks)
    rows = requests.withColumns({"_asked_height": F.col("height"), "_asked_level": F.col("level")})
    rows = _join_narrowed(rows, found("rider", ("rider_rate",)), "rider", "er")
    rows = _join_narrowed(rows, found("horse", ("horse_rate", "club_rate")), "horse", "eh")
    return _computed(_based(_described(history, rows, n, *sums)), density)


def _described(history: DataFrame, requests: DataFrame, n: int, *sums: str) -> DataFrame:
    """requests with their resolved family and what the history says of horse and family, whatever height and level are asked."""
    rows = requests.join(_horses(history, n, *sums), "horse", "left")
    families, every = _families(history)
    rows = rows.join(F.broadcast(every), how="left")  # one row
    rows = rows.withColumnRenamed("family", "given").join(families.select("_family", F.lit(True).alias("_known")), F.col("given") == F.col("_family"), "left").drop("_family")
    rows = rows.withColumn("family", F.when(F.col("_known"), F.col("given")).otherwise(F.coalesce("_usual", "_every"))).drop("_known", "_usual", "_every")
    rows = rows.join(families, F.col("family") == F.col("_family"), "left").drop("_family")
    return rows.withColumns({"_hf": F.col("_by")[F.col("family")], "_points": F.col("_h.points")})


def _based(rows: DataFrame) -> DataFrame:
    """Described rows with `_b`, the portrait that counts, in place of the others; what it lacks is everyone's, but for sex, coat and team."""
    c = F.col
    told = lambda x: F.when(c("_h").isNull(), F.when(c("_f").isNull(), c(f"_a.{x}")).otherwise(c(f"_f.{x}"))).when(c("_hf.n") >= 2, c(f"_hf.{x}")).otherwise(c(f"_h.{x}"))
    fields = [told(x).alias(x) for x in ("sex", "coat", "team")] + [F.coalesce(told(x), c(f"_a.{x}")).alias(x) for x in ("size", "kind", "level", "height", "field", "level_num")]
    return rows.withColumn("_b", F.struct(*fields)).drop("_hf", "_f", "_a", "_by")


def _computed(rows: DataFrame, density: str = "") -> DataFrame:
    """The features of based rows (_based) with their narrowed statistics (_eh_, _er_)."""
    rows = rows.withColumns(
        {
            "sex": F.coalesce("_b.sex", F.lit(USUAL_SEX)),
            "coat": F.coalesce("_b.coat", F.lit(USUAL_COAT)),
            "size": F.col("_b.size"),
            "kind": F.col("_b.kind"),
            "height": F.coalesce(F.col("_asked_height").cast("double"), F.col("_b.height")),
            "level": F.coalesce(F.col("_asked_level"), F.col("_b.level")),
            "team": F.bround(F.coalesce("_b.team", F.lit(0.0))).cast("int"),
            "field": F.bround(F.col("_b.field")).cast("int"),
            "level_num": F.col("_b.level_num"),
            "horse_rate": F.coalesce("_eh_horse_rate", F.lit(FIRST_RATE)),
            "horse_starts": F.coalesce("_eh_horse_starts", F.lit(0)),
            "rider_rate": F.coalesce("_er_rider_rate", F.lit(FIRST_RATE)),
            "rider_starts": F.coalesce("_er_rider_starts", F.lit(0)),
            "club_rate": F.coalesce("_eh_club_rate", F.lit(FIRST_RATE)),
            "points": F.coalesce("_points", F.lit(0.0)),
            "density": F.lit(density),
        }
    )
    synergy = F.col("horse_rate") * F.col("rider_rate")
    rows = rows.withColumns(
        {
            "synergy": synergy,
            "experience": F.when(F.col("height") != 0, F.col("horse_starts") / (F.col("height") / 10 + 1)).otherwise(F.col("horse_starts").cast("double")),
            "horse_x_level": F.col("horse_rate") * F.col("level_num"),
            "horse_x_height": F.col("horse_rate") * F.col("height") / 100,
            "rider_x_level": F.col("rider_rate") * F.col("level_num"),
            "rider_x_height": F.col("rider_rate") * F.col("height") / 100,
            "synergy_x_level": synergy * F.col("level_num"),
        }
    )
    return rows.drop("_b", "_points", *[c for c in rows.columns if c.startswith(("_eh_", "_er_"))])


FEATURES = (
    "sex", "coat", "size", "family", "height", "horse_x_level", "horse_x_height", "rider_x_level", "rider_x_height", "synergy_x_level", "level", "kind",
    "team", "field", "level_num", "horse_rate", "horse_starts", "rider_rate", "rider_starts", "club_rate", "synergy", "experience", "points", "density",
)


def _percent(proba: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(proba).cast("int")))


def predictions(history: DataFrame, requests: DataFrame, proba: Column) -> DataFrame:
    """feature_vectors with proba (0 to 100, of `proba` over the features), totals of horse, rider and pair, age and cold.

    A pair is cold if its horse or its rider has no history.
    """
    n = history.count()
    rows = _vectors(history, requests, n, "won").withColumn("proba", _percent(proba))
    rows = rows.withColumns({"horse_runs": F.col("_h.n"), "horse_wins": F.col("_h.sum_won")})
    rows = rows.join(_totals(history, ["rider"], "rider"), "rider", "left").join(_pairs(history, requests, n), ["horse", "rider"], "left")
    rows = rows.withColumn("cold", F.col("horse_runs").isNull() | F.col("rider_runs").isNull()).drop("_h")
    rows = rows.fillna(0, [f"{n}_{k}" for n in ("horse", "rider", "pair") for k in ("runs", "wins")])
    return rows.withColumn("age", pseudo_age(F.col("horse_runs")))


def _totals(history: DataFrame, keys: list[str], name: str) -> DataFrame:
    return history.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_runs"), F.sum("won").alias(f"{name}_wins"))


def _pairs(history: DataFrame, requests: DataFrame, n: int) -> DataFrame:
    """Totals of the requested pairs of horse and rider, staged."""
    found = requests.select("horse", "rider").distinct().join(_totals(history, ["horse", "rider"], "pair"), ["horse", "rider"])
    return stage(found, "pairs", free=True, partitions=tasks_for(history.sparkSession, n))


def _ranked(rows: DataFrame) -> DataFrame:
    """rank from proba, the family's median field and the exact mean ranks horse_mean and rider_mean."""
    raw = profiles.estimated_rank(F.col("proba"), F.col("median_field"))
    rows = rows.withColumn("raw_rank", raw)
    return rows.withColumn("rank", profiles.blended_rank(F.col("raw_rank"), F.col("proba"), F.col("horse_mean"), F.col("rider_mean")))


def by_family(history: DataFrame, pairs: DataFrame, fields: DataFrame, proba: Column) -> DataFrame:
    """A prediction for each family in which the pair's horse or rider has a history, with means of that family.

    fields: family, median_field. `place` orders a pair's rows by proba, then family.
    """
    n = history.count()
    keep = lambda entity, means, prefix: stage(_overall(history, entity, means, prefix), f"overall-{entity}", free=True, partitions=tasks_for(history.sparkSession, n))
    pairs = pairs.select("horse", "rider").distinct()
    rows = pairs.join(_pairs(history, pairs, n), ["horse", "rider"], "left")
    rows = rows.join(_horses(history, n), "horse", "left").drop("_usual").join(keep("horse", ("horse_rate", "club_rate"), "eh"), "horse", "left")
    # Riders last: a pair's families are unfolded and placed where its rider's rows are.
    rows = rows.join(keep("rider", ("rider_rate",), "er"), "rider", "left")
    seen = [F.coalesce(F.map_keys(f"_of_{e}"), F.array().cast(f"array<{dict(history.dtypes)['family']}>")) for e in ("horse", "rider")]
    rows = rows.withColumn("family", F.explode(F.array_union(*seen)))
    rows = rows.withColumns({f"{e}_{k}": F.col(f"_of_{e}")[F.col("family")][k] for e in ("horse", "rider") for k in ("runs", "mean")}).drop("_of_horse", "_of_rider")
    rows = rows.withColumns({"given": F.col("family"), "_hf": F.col("_by")[F.col("family")], "_points": F.col("_h.points"), "_asked_height": F.lit(None).cast("int"), "_asked_level": F.lit(None).cast("int")})
    families, every = _families(history)
    rows = rows.join(families, F.col("family") == F.col("_family"), "left").drop("_family").join(F.broadcast(every), how="left").drop("_every")
    rows = rows.withColumns({"cold": F.col("_horse_n").isNull() | F.col("_rider_n").isNull(), "age": pseudo_age(F.coalesce("_horse_n", F.lit(0)))}).drop("_horse_n", "_rider_n")
    rows = _computed(_based(rows)).drop("_h").withColumn("proba", _percent(proba))
    rows = _ranked(rows.join(fields, "family", "left")).fillna(0, [f"{x}_{k}" for x in ("horse", "rider", "pair") for k in ("runs", "wins")])
    return profiles.ranked_within(rows, ["horse", "rider"], [F.desc("proba"), F.col("family")], "place")


def _overall(history: DataFrame, entity: str, means: tuple[str, ...], prefix: str) -> DataFrame:
    """entity, `_of_<entity>`: its runs and mean rank by family; its number of rows, wins, and the means and greatest number of starts of all its rows."""
    starts = f"{entity}_starts"
    sums = [x for c in means for x in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))]
    known = history.where(F.col(entity).isNotNull())
    cells = known.groupBy(entity, "family").agg(F.count(F.lit(1)).alias("runs"), F.avg("rk").alias("mean"), F.sum("won").alias("won"), F.max(starts).alias("most"), *sums)
    by = F.map_from_entries(F.collect_list(F.when(F.col("family").isNotNull(), F.struct("family", F.struct("runs", "mean")))))
    rates = [(F.sum(f"s_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(f"_{prefix}_{c}") for c in means]
    return cells.groupBy(entity).agg(by.alias(f"_of_{entity}"), F.sum("runs").alias(f"_{entity}_n"), F.sum("won").alias(f"{entity}_wins"), F.max("most").alias(f"_{prefix}_{starts}"), *rates)


def _cells(history: DataFrame, entity: str, means: tuple[str, ...], n: int) -> DataFrame:
    """Counts and sums of an entity's rows by family, height and level, staged."""
    sums = [x for c in ("rk", *means) for x in (F.sum(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))]
    cells = history.where(F.col(entity).isNotNull()).groupBy(entity, "family", "height", "level").agg(F.count(F.lit(1)).alias("runs"), F.max(f"{entity}_starts").alias("most"), *sums)
    return stage(cells, f"cells-{entity}", free=True, partitions=tasks_for(history.sparkSession, n))


def _scopes(cells: DataFrame, entity: str, means: tuple[str, ...], name: str, tasks: int) -> DataFrame:
    """entity, `name`: what `narrowed` can leave of an entity, as maps by height, by level and by both, and of all its rows; `_of_<entity>`: runs and mean rank by family, height and level.

    Cells go to one of `tasks` by entity and are summed there by every scope that they count in.
    """
    c, scope = F.col, F.col("scope")
    none = {k: F.lit(None).cast(t) for k, t in cells.dtypes if k in ("family", "height", "level")}
    sets = [("height", "level"), ("height",), ("level",), (), ("family", "height", "level")]  # scopes 0 to 4
    known = lambda keys: F.coalesce(*[F.when(c(k).isNull(), False) for k in keys], F.lit(True))
    sets = F.array(*[F.when(known(keys), F.struct(F.lit(i).alias("scope"), *[(c(k) if k in keys else x).alias(k) for k, x in none.items()])) for i, keys in enumerate(sets)])
    sums = [f"{k}_{m}" for m in ("rk", *means) for k in "sn"]
    rows = cells.repartition(tasks, entity).select(entity, "runs", "most", *sums, F.inline(F.array_compact(sets)))
    rows = rows.groupBy(entity, "scope", "family", "height", "level").agg(F.sum("runs").alias("runs"), F.max("most").alias("most"), *[F.sum(x).alias(x) for x in sums])
    mean = lambda m: c(f"s_{m}") / F.nullif(c(f"n_{m}"), F.lit(0))
    stat = F.struct(*[mean(m).alias(m) for m in means], c("most").alias(f"{entity}_starts"))
    runs = F.struct(c("runs").alias(f"{entity}_runs"), mean("rk").alias(f"{entity}_mean"))
    listed = lambda i, *entry: F.collect_list(F.when(scope == i, F.struct(*entry)))
    both = F.struct("height", "level").alias("key")
    maps = [F.map_from_entries(listed(i, key, stat.alias("value"))).alias(k) for i, key, k in ((0, both, "exact"), (1, c("height"), "tall"), (2, c("level"), "same"))]
    return rows.groupBy(entity).agg(F.struct(*maps, F.max(F.when(scope == 3, stat)).alias("all")).alias(name), listed(4, "family", both, runs.alias("value")).alias(f"_of_{entity}"))


def _of_family(name: str) -> Column:
    """Of `name`, runs by family, height and level, those of the row's family as a map by height and level."""
    own = F.filter(name, lambda x: x["family"] == F.col("family"))
    return F.map_from_entries(F.transform(own, lambda x: F.struct(x["key"], x["value"])))


def _picked(name: str) -> Column:
    """The statistics at exactly the height, and of these at the level; else at the level; else all."""
    c = F.col
    tall, same, exact = c(f"{name}.tall")[c("height")], c(f"{name}.same")[c("level")], c(f"{name}.exact")[F.struct("height", "level")]
    return F.when(tall.isNotNull(), F.coalesce(F.when(c("level").isNotNull(), exact), tall)).otherwise(F.coalesce(same, c(f"{name}.all")))


#: Up to so many combinations, all families together, go to every task.
FEW_COMBOS = 500_000


def by_combo(history: DataFrame, asked: DataFrame, fields: DataFrame, proba: Column) -> DataFrame:
    """A prediction for each height and level that anyone has run in the asked family, with means of exactly that combination.

    asked: horse, rider, family and, to fix an axis, height or level. `place` orders a
    request's rows by height (none first), then level. Everything that the history says is joined to the
    requests, as maps by height and level; a rider's maps, the largest, are made where they are read and are
    never shuffled, and nor are combinations, which come last.
    """
    c, spark = F.col, history.sparkSession
    n = history.count()
    tasks = max(tasks_for(spark, n), 4 * spark.sparkContext.defaultParallelism)
    height = F.when(c("height") > 0, c("height"))
    combos = history.select("family", height.alias("height"), "level").distinct()
    combos = combos.groupBy(c("family").alias("_of")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("height", F.lit(0)).alias("at"), "level", "height"))).alias("_combos"))
    combos = stage(combos, "combinations", free=True)
    few = (combos.agg(F.sum(F.size("_combos"))).first()[0] or 0) <= FEW_COMBOS
    axes = asked.where("family IS NOT NULL").groupBy("horse", "rider", "family").agg(F.collect_set(F.struct("height", "level")).alias("_axes"))
    rows = axes.join(_pairs(history, axes, n), ["horse", "rider"], "left")
    rows = _based(_described(history, rows, n, "won"))
    rows = rows.withColumns({"_horse_n": c("_h.n"), "horse_wins": c("_h.sum_won")}).drop("_h")
    horse, rider = (_cells(history, e, m, n) for e, m in (("horse", ("horse_rate", "club_rate")), ("rider", ("rider_rate",))))
    rows = rows.join(_scopes(horse, "horse", ("horse_rate", "club_rate"), "_eh", tasks), "horse", "left").withColumn("_of_horse", _of_family("_of_horse"))
    rows = rows.join(fields, "family", "left").join(_totals(history, ["rider"], "_rider"), "rider", "left").withColumnsRenamed({"_rider_runs": "_rider_n", "_rider_wins": "rider_wins"})
    rows = rows.join(_scopes(rider, "rider", ("rider_rate",), "_er", tasks), "rider", "left").withColumn("_of_rider", _of_family("_of_rider"))
    rows = rows.join(F.broadcast(combos) if few else combos, c("given") == c("_of")).drop("_of")
    # An axis that is not asked takes any value.
    fits = lambda x: F.exists("_axes", lambda a: (a["height"].isNull() | F.coalesce(a["height"] == x["height"], F.lit(False))) & (a["level"].isNull() | F.coalesce(a["level"] == x["level"], F.lit(False))))
    # Rows lie so already, by the join with riders; only where Spark joined otherwise they are dealt.
    rows = rows.repartition(tasks, "rider").select("*", F.posexplode(F.filter("_combos", fits)).alias("_at", "_c")).drop("_combos", "_axes")
    rows = rows.withColumns({"place": c("_at") + 1, "height": c("_c.height"), "level": c("_c.level")}).drop("_at", "_c")
    rows = rows.withColumns({"_asked_height": c("height"), "_asked_level": c("level"), "_eh": _picked("_eh"), "_er": _picked("_er")})
    both = F.struct("height", "level")
    exact = {e: F.when(c("height").isNotNull() & c("level").isNotNull(), c(f"_of_{e}")[both]) for e in ("horse", "rider")}
    rows = rows.withColumns({f"{e}_{k}": x[f"{e}_{k}"] for e, x in exact.items() for k in ("runs", "mean")}).drop("_of_horse", "_of_rider")
    rows = rows.withColumns({"_eh_horse_rate": c("_eh.horse_rate"), "_eh_club_rate": c("_eh.club_rate"), "_eh_horse_starts": c("_eh.horse_starts"), "_er_rider_rate": c("_er.rider_rate"), "_er_rider_starts": c("_er.rider_starts")}).drop("_eh", "_er")
    rows = _computed(rows).withColumn("proba", _percent(proba)).withColumn("cold", c("_horse_n").isNull() | c("_rider_n").isNull())
    rows = rows.withColumn("age", pseudo_age(F.coalesce("_horse_n", F.lit(0)))).drop("_horse_n", "_rider_n")
    rows = rows.drop("height", "level").withColumnsRenamed({"_asked_height": "height", "_asked_level": "level"})
    rows = rows.fillna(0, ["horse_wins", "rider_wins", "pair_wins", "pair_runs", "horse_runs", "rider_runs"])
    return _ranked(rows)


def batch(history: DataFrame, entries: DataFrame, proba: Column) -> DataFrame:
    """predictions of entries (horse, rider, family), known or not, with the verdict; cold pairs are labelled so.

    An entry without a horse or a family can't be predicted: proba is null, the verdict "inconnu".
    """
    asked = entries.withColumns({"height": F.lit(None).cast("int"), "level": F.lit(None).cast("int")})
    rows = predictions(history, asked, proba)
    lacks = F.col("horse").isNull() | F.col("given").isNull()
    rows = rows.withColumn("verdict", F.when(lacks, "inconnu").otherwise(verdict(F.col("proba"), F.col("cold"))))
    return rows.withColumns({"proba": F.when(~lacks, F.col("proba")), "cold": F.col("cold") | lacks})
