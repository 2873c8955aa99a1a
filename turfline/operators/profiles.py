"""Per-entity history aggregates, scope cascades and rank estimates, set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import stage
from .relational import dealt


def totals(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum("won").alias("wins"), F.count(F.lit(1)).alias("starts"), F.round(F.avg("rk"), 6).alias("mean_rank"))


def cascade(history: DataFrame, requests: DataFrame, entity: str, min_rows: int = 3) -> DataFrame:
    """The narrowest scope with at least min_rows rows, else the broadest with one, marked low_data.

    requests: entity, family, height, level. The history is summed by entity and combination
    before it meets the requests, so a hot entity is as many rows as it has
    combinations, and a million requests are one aggregation.
    """
    cells = history.groupBy(entity, *[F.col(c).alias(f"h_{c}") for c in ("family", "height", "level")]).agg(F.count(F.lit(1)).alias("_n"), F.sum("won").alias("_w"))
    disc = F.col("h_family") == F.col("family")
    tall, lvl = F.col("h_height") == F.col("height"), F.col("h_level") == F.col("level")
    scopes = [("family_height_level", disc & tall & lvl), ("family_height", disc & tall), ("family_level", disc & lvl), ("family", disc), ("all", F.lit(True))]
    joined = requests.join(cells, entity)
    counts = [F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).alias(f"n{i}") for i, (_, c) in enumerate(scopes)]
    wins = [F.coalesce(F.sum(F.when(c, F.col("_w"))), F.lit(0)).alias(f"w{i}") for i, (_, c) in enumerate(scopes)]
    agg = joined.groupBy(entity, "family", "height", "level").agg(*counts, *wins)
    enough = F.coalesce(*[F.when(F.col(f"n{i}") >= min_rows, F.lit(i)) for i in range(5)])
    broadest = F.coalesce(*[F.when(F.col(f"n{i}") >= 1, F.lit(i)) for i in range(4, -1, -1)])
    chosen = agg.withColumn("_i", F.coalesce(enough, broadest)).withColumn("low_data", enough.isNull())
    pick = lambda p: F.element_at(F.array(*[F.col(f"{p}{i}") for i in range(5)]), F.col("_i") + 1)
    name = F.element_at(F.array(*[F.lit(n) for n, _ in scopes]), F.col("_i") + 1)
    return chosen.select(entity, "family", "height", "level", name.alias("scope"), pick("n").alias("starts"), pick("w").alias("wins"), "low_data")


def family_or_all(history: DataFrame, requests: DataFrame, entity: str) -> DataFrame:
    """History in the requested family if it has two rows, else everything; unknown entities get the population."""
    fam = history.groupBy(entity, "family").agg(F.count(F.lit(1)).alias("fn"), F.sum("won").alias("fw"))
    every = history.groupBy(entity).agg(F.count(F.lit(1)).alias("en"), F.sum("won").alias("ew"))
    pop_family = history.groupBy("family").agg(F.count(F.lit(1)).alias("pn"), F.sum("won").alias("pw"))
    out = requests.join(fam, [entity, "family"], "left").join(every, entity, "left").join(pop_family, "family", "left")
    whole = history.agg(F.count(F.lit(1)).alias("an"), F.sum("won").alias("aw"))
    out = out.join(F.broadcast(whole))  # one row
    levels = [("family", F.col("fn") >= 2, "fn", "fw"), ("entity", F.col("en").isNotNull(), "en", "ew"), ("population_family", F.col("pn").isNotNull(), "pn", "pw")]
    basis, n, w = F.lit("population"), F.col("an"), F.col("aw")
    for name, when, cn, cw in reversed(levels):
        basis, n, w = F.when(when, name).otherwise(basis), F.when(when, F.col(cn)).otherwise(n), F.when(when, F.col(cw)).otherwise(w)
    return out.select(entity, "family", basis.alias("basis"), n.alias("starts"), w.alias("wins"))


def pair_families(rows: DataFrame) -> DataFrame:
    """horse, rider, family, each once: for every pair that ran, all families (null is one) in which its horse or its rider has a history.

    Families are gathered by horse and by rider, so shuffles carry a row a pair or participation, and pairs are unfolded last.
    """
    rows = stage(rows.select("horse", "rider", "family"), "pair-families")
    n = rows.count()

    def gathered(entity: str) -> DataFrame:
        held = dealt(rows.where(F.col(entity).isNotNull()).select(entity, "family"), n, entity)
        sets = held.groupBy(entity).agg(F.collect_set("family").alias("_held"), F.bool_or(F.col("family").isNull()).alias("_none"))
        return sets.select(entity, F.when(F.col("_none"), F.array_append("_held", F.lit(None))).otherwise(F.col("_held")).alias(f"_by_{entity}"))

    pairs = dealt(rows.where("horse IS NOT NULL AND rider IS NOT NULL").select("horse", "rider"), n, "horse").distinct()
    both = dealt(pairs.join(gathered("horse"), "horse"), n, "rider").join(gathered("rider"), "rider")
    return both.select("horse", "rider", F.explode(F.array_union("_by_horse", "_by_rider")).alias("family"))


def estimated_rank(percent: Column, median_field: Column) -> Column:
    """1 + half-even((100 - p) / 100 * (n - 1)), with n the whole part of the median field, 12 without, 2 at least."""
    n = F.greatest(F.lit(2), F.coalesce(median_field.cast("int"), F.lit(12)))
    p = F.greatest(F.lit(0), F.least(F.lit(100), percent.cast("int")))
    raw = F.bround((100 - p) / 100 * (n - 1)).cast("int") + 1
    return F.greatest(F.lit(1), F.least(raw, n))


def blended_rank(raw: Column, percent: Column, *means: Column) -> Column:
    """The raw rank pulled towards the mean of the known mean ranks, never better than raw."""
    known = F.array_compact(F.array(*means))
    history = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    w = F.least(F.lit(0.7), percent / 100)
    blend = F.bround(history * (1 - w) + raw * w).cast("int")
    return F.when(F.size(known) > 0, F.greatest(raw, blend)).otherwise(raw)


def ranked_within(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def latest(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The n last rows of each key, `order` being newest first; age 1 is the newest."""
    return ranked_within(rows, key, order, "age").where(F.col("age") <= n)


#: The sentences and tones below are outputs that must match.
def form_sentence(pair_starts: Column, pair_wins: Column, recent_wins: Column, recent_starts: Column) -> Column:
    """A sentence on recent form: of the pair if it has a history, else of the horse."""
    rate = pair_wins / pair_starts
    tone = F.when(rate >= 0.5, "solide").when(rate >= 0.2, "irrégulière").otherwise("fragile")
    pair = F.format_string("Duo %s — %d sorties communes, %d réussites. Cheval : %d/%d sur ses 5 dernières.", tone, pair_starts, pair_wins, recent_wins, recent_starts)
    return (
        F.when(pair_starts > 0, pair)
        .when(recent_starts == 0, "Aucune sortie récente exploitable, prédiction basée sur les caractéristiques.")
        .when(recent_wins >= 3, F.format_string("En grande forme : %d réussites sur les %d dernières sorties.", recent_wins, recent_starts))
        .when(recent_wins == 0, F.format_string("En manque de résultats : 0 réussite sur les %d dernières sorties.", recent_starts))
        .otherwise(F.format_string("Forme correcte : %d/%d réussites récentes.", recent_wins, recent_starts))
    )
