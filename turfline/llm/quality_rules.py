"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Per document: word statistics (text_stats). Per (lang, source): a quantile sketch of
every ratio, from which fences replace fixed cutoffs. The sketch is a log-bucket
histogram (relative error 2 % of the value, as in DDSketch) held as rows (group,
metric, bucket, count): merging is addition, so it pre-aggregates before the shuffle,
a hot source costs one row per bucket and task, and results never depend on order.

Small groups: a group's sketch is its own counts plus `prior` further rows that are spread
as in its language, and a language's plus `prior` rows spread as everything. So a fence
moves from its parent's place to its own as a group grows, without a switch.

Fences, with quantiles of the group:
* The mean word length fails beyond 3 quartile ranges from the quartiles, by more than one standard error of a
  mean of n word lengths.
* The share of symbols is read by its square root, which has the same sampling error at any share. Its quantiles are
  weighted by words, so that long texts, whose shares are sure, say what is usual, and not the zeros of short ones.
  It fails above Q50 + 7 * (Q50 - Q25), which junk can't move while it holds under half of a group's words, by more than
  one symbol in a text of the group's median length and five standard errors of a share among n words. So a
  short text and a long one of equal habits are judged alike.
* The shares of repeats are 0 in most documents, so that quartiles say nothing of them: by -log(1 - x), on which no fence lies
  beyond 1, these fail above Q99 + 3 * (Q99 - Q50), which in a clean group lies far below the base cutoff.
Documents that fail the base rules are outside the sketches, so that plain junk cannot move a fence.

Defined results: a null text has no words and fails the base rules; null lang or
source are groups of their own; repeated rows count each; an empty table gives no
rows; other input columns are ignored by quality_verdicts and kept by keep_clean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..staging import arrow_batches, stage
from .skew import small_or_joined
from .text_stats import text_stats
from .workers import give_back

#: metric -> (numerator, denominator, weight, lower and upper quantile, how far beyond the upper one its fence lies in distances of the two, sampling error by the root of the denominator, whether low values fail too)
METRICS = {
    "word_length": ("word_chars", "n_words", None, 0.25, 0.75, 3, 0.5, True),
    "symbol_share": ("n_symbols", "n_words", "n_words", 0.25, 0.5, 7, 2.5, False),
    "dup_line_share": ("n_dup_lines", "n_lines", None, 0.5, 0.99, 3, 0.0, False),
    "repeat_share": ("n_repeat_words", "n_words", None, 0.5, 0.99, 3, 0.0, False),
}
#: Sketched beside them: the number of words.
LENGTH = "length"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_GAMMA = 1.02 / 0.98
_LEAST = 1e-4
#: Rows with a text in an Arrow batch.
TEXTS = 256
_STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@F.pandas_udf(StructType([StructField(c, LongType()) for c in _STATS]))
def _measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_stats(x) for x in batch], columns=_STATS)
    give_back()


def with_text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The `keep` columns and the statistics of `text`; whole texts, one pass, only texts go to Python.

    Called non-deterministic, or a later filter on a statistic would measure every text once more.
    """
    measured = _measured.asNondeterministic()(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(*keep, measured.alias("_stats")).select(*keep, "_stats.*")


def _ratio(metric: str) -> F.Column:
    top, bottom = METRICS[metric][:2]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def _scaled(metric: str, x: F.Column) -> F.Column:
    if metric == "symbol_share":
        return F.sqrt(x)
    return -F.log(1 - F.least(x, F.lit(1 - 1e-9))) if METRICS[metric][1] == "n_lines" or metric == "repeat_share" else x


def sketch(stats: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n, w: documents and their weight. Bucket i holds (g^(i-1), g^i]; bucket -1000: about 0."""
    weighed = lambda m: F.col(METRICS[m][2]).cast("double") if METRICS[m][2] else F.lit(1.0)
    ratios = [F.struct(F.lit(m).alias("metric"), _ratio(m).alias("x"), weighed(m).alias("weight")) for m in METRICS]
    ratios.append(F.struct(F.lit(LENGTH).alias("metric"), F.col("n_words").cast("double").alias("x"), F.lit(1.0).alias("weight")))
    long = stats.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*ratios)).alias("r")).select("lang", "source", "r.*")
    bucket = F.when(F.col("x") < _LEAST, F.lit(-1000)).otherwise(F.ceil(F.log(F.col("x")) / math.log(_GAMMA)).cast("int"))
    return long.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null; the right side's keys go."""
    on = F.lit(True)
    for c in keys:
        on = on & left[c].eqNullSafe(right[c])
    out = left.join(right, on, how)
    for c in keys:
        out = out.drop(right[c])
    return out


def smoothed(sketched: DataFrame, prior: float) -> DataFrame:
    """The sketch of each (lang, source) with `prior` documents spread as in its language, whose own has as many spread as everything."""
    total = [F.sum("n").cast("double").alias("n"), F.sum("w").alias("w")]
    parent = sketched.groupBy("metric", "bucket").agg(*total)
    keys: list[str] = []
    for group in (["lang"], ["lang", "source"]):
        every = parent.groupBy(*keys, "metric").agg(F.sum("n").alias("_all"))
        parent = _same(parent, every.toDF(*[f"_k{i}" for i in range(len(keys))], "_metric", "_all").withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keys)} | {"_metric": "metric"}), [*keys, "metric"], "inner")
        parent = parent.select(*keys, "metric", "bucket", *[(F.lit(float(prior)) * F.col(c) / F.col("_all")).alias(c) for c in ("n", "w")])
        own = sketched.groupBy(*group, "metric", "bucket").agg(*total)
        groups = own.select(*group, "metric").distinct()
        spread = _same(groups, parent, [*keys, "metric"], "inner")
        parent = spread.unionByName(own).groupBy(*group, "metric", "bucket").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        keys = group
    return parent


def quantiles(sketched: DataFrame, group: list[str]) -> DataFrame:
    """Merge sketches to `group` and read the weighted quantiles: group, metric, total (the weight), q25, q50, q75, q99."""
    merged = sketched.groupBy(*group, "metric", "bucket").agg(F.sum("w").alias("w"))
    part = Window.partitionBy(*group, "metric")
    run = merged.withColumn("upto", F.sum("w").over(part.orderBy("bucket"))).withColumn("total", F.sum("w").over(part))
    value = F.when(F.col("bucket") == -1000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(_GAMMA), F.col("bucket")) / (_GAMMA + 1))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * (q - 1e-9), value)).alias(f"q{round(100 * q)}")
    return run.groupBy(*group, "metric").agg(F.max("total").alias("total"), *map(at, (0.25, 0.5, 0.75, 0.99)))


def fences(sketched: DataFrame, prior: float) -> DataFrame:
    """lang, source and per metric a lower and an upper fence and the unit of sampling error, on the metric's scale."""
    found = quantiles(smoothed(sketched, prior), ["lang", "source"])
    length = F.max(F.when(F.col("metric") == LENGTH, F.col("q50")))
    out = []
    for m, (_, _, _, low, high, stretch, error, both) in METRICS.items():
        at = lambda q, m=m: F.max(F.when(F.col("metric") == m, _scaled(m, F.col(f"q{round(100 * q)}"))))
        width = stretch * (at(high) - at(low))
        room = 1 / F.sqrt(length) if m == "symbol_share" else F.lit(0.0)
        out += [
            (at(low) - width if both else F.lit(None).cast("double")).alias(f"{m}_lower"),
            (at(high) + width + room).alias(f"{m}_upper"),
            (error * at(0.5) if m == "word_length" else F.lit(error)).alias(f"{m}_error"),
        ]
    return found.groupBy("lang", "source").agg(*out)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """Add failed_rules and kept to rows that carry lang, source, the statistics and base_failed."""
    limits = small_or_joined(limits.withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = stats.join(limits, on, "left")
    rules = []
    for m, (_, bottom, *_, both) in METRICS.items():
        x, error = _scaled(m, _ratio(m)), F.col(f"{m}_error") / F.sqrt(F.greatest(F.col(bottom), F.lit(1)))
        out = x > F.col(f"{m}_upper") + error
        out = out | (x < F.col(f"{m}_lower") - error) if both else out
        rules.append(F.when(F.coalesce(out, F.lit(False)), F.lit(m)))
    joined = joined.withColumn("failed_rules", F.array_compact(F.array(*rules)))
    joined = joined.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return joined.drop("_lang", "_source", *[f"{m}_{c}" for m in METRICS for c in ("lower", "upper", "error")])


def quality_verdicts(docs: DataFrame, prior: float = 100) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, failed_rules, kept: one row per input row."""
    with arrow_batches(docs.sparkSession, TEXTS):
        stats = stage(with_text_stats(docs, ["doc_id", "lang", "source"]).withColumn("base_failed", base_failed()), "quality-stats")
    return verdict(stats, stage(fences(stage(sketch(stats), "quality-sketch"), prior), "quality-fences"))


def keep_clean(docs: DataFrame, prior: float = 100) -> DataFrame:
    """The rows of docs that are kept, with all their columns and in one row each.

    Every text is measured once: the rows are staged with their statistics, the fences
    (one row per group) are made from these, and the staged rows are filtered in place.
    Rows that fail the base rules are out before, and nothing is shuffled but sketches.
    """
    names = docs.columns
    own = {"base_failed", "failed_rules", "kept", *_STATS}
    plain = docs.toDF(*[f"_c{i}" if n.lower() in own else n for i, n in enumerate(names)])
    with arrow_batches(docs.sparkSession, TEXTS):
        measured = stage(with_text_stats(plain, plain.columns).withColumn("base_failed", base_failed()).where("NOT base_failed"), "quality-rows")
    return verdict(measured, stage(fences(stage(sketch(measured), "quality-sketch"), prior), "quality-fences")).where("kept").select(*plain.columns).toDF(*names)
