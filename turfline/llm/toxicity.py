"""Toxicity by a counterfactual-regularised classifier.

Features of a text: its distinct lower-case words, and their first four and five
letters, each present or not. A logistic model over the most telling features is
fitted to labelled texts, with one more penalty on pairs of counterfactual sentences: the
squared change of the score, weighted by how often the pair occurs. So the model can't lean
on the mention of a group, which keeps neutral mentions from scoring as toxic. Pairs:

* every labelled sentence with an identity term, and the same with the term swapped for
  another of its group;
* one sentence of every labelled text, with one of its even words (a word that tells nothing
  of the label) replaced by an identity term, against the sentence itself and against the
  next term of the group. So every term is met in the corpus's own sentences,
  though the labelled texts may never mention it;
* the same with the corpus's own even words, which are the ones spread most evenly over
  both labels: these are interchangeable too, and must not add up to a verdict.

Fitting reads at most `max_rows` labelled rows (those of the smallest seeded hash, staged
once) and `max_pairs` different pairs; scoring reads every whole text, in one pass without
a shuffle. The counting of features over the fitted rows is a Spark job that
pre-aggregates in each task; only the `n_features` chosen ones reach the driver. Toxic rows
weigh `toxic_weight` times as much, since they are few.

Labels, language, source and doc_id are never features.

Defined results: a null or empty text has no features and gets the score of the
intercept; labels that are null or neither 0 nor 1 are no labels; of repeated labels
of a document the largest counts; without both kinds of label every score is the share
of ones among the labels, or 0; repeated rows are scored each; an empty table gives no
rows; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import arrow_batches, stage, unstage
from .workers import give_back

#: Groups of terms that are swapped for each other; a parameter of fit.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "african", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "hindúes"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Remembered words per worker process; bounds memory, never changes a score.
WORD_LIMIT = 20_000
#: Rows with a text in an Arrow batch.
TEXTS = 256


def word_features(word: str) -> list[str]:
    """The word, and its beginnings marked as such."""
    return [word, *(word[:k] + "*" for k in (4, 5) if len(word) >= k)]


def text_features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}


def swapped_sentences(text: str | None, swaps: dict[str, str]) -> Iterator[tuple[str, str]]:
    """(sentence, the sentence with its identity terms swapped)."""
    for sentence in _SENTENCE.findall((text or "").lower()):
        words = _WORD.findall(sentence)
        if any(w in swaps for w in words):
            yield sentence, _WORD.sub(lambda m: swaps.get(m[0], m[0]), sentence)


@dataclass
class ToxicityModel:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)
    #: Different counterfactual pairs that the fit was penalised on.
    pairs: int = 0

    def scorer(self):
        """A function from text to score that remembers words without features."""
        weights, seen = self.weights, {}

        def score(text: str | None) -> float:
            found: set[str] = set()
            for word in set(_WORD.findall((text or "").lower())):
                hit = seen.get(word)
                if hit is None:
                    if len(seen) > WORD_LIMIT:
                        seen.clear()
                    hit = seen[word] = tuple(f for f in word_features(word) if f in weights)
                if hit:
                    found.update(hit)
            z = self.intercept + sum(weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: F.Column, max_rows: int, seed: int) -> DataFrame:
    """text, toxic of at most max_rows labelled documents for which `allowed` holds.

    The chosen ids are at most max_rows, so they are broadcast and no text is shuffled.
    """
    ones = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
    ones = ones.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = ones.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def telling_features(sample: DataFrame, n_features: int, least: int, least_gain: float = 5.0, n_even: int = 64) -> tuple[list[str], list[str]]:
    """The features whose presence tells most about the label (log-likelihood ratio), and words in a hundredth of the rows or more that tell least."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            by = (Counter(), Counter())
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                by[int(toxic)].update(text_features(text))
            names = list(by[0].keys() | by[1].keys())
            yield pd.DataFrame({"f": names, "n0": [by[0][x] for x in names], "n1": [by[1][x] for x in names]})

    total = sample.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    n0, n1 = (float(x) for x in total)
    if not n0 or not n1:
        return [], []
    counts = sample.mapInPandas(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.where(F.col("n0") + F.col("n1") >= least)
    seen, n = F.col("n0") + F.col("n1"), n0 + n1
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    gain = part(F.col("n0"), seen * n0 / n) + part(F.col("n1"), seen * n1 / n) + part(n0 - F.col("n0"), (n - seen) * n0 / n) + part(n1 - F.col("n1"), (n - seen) * n1 / n)
    counts = stage(counts.select("f", F.round(gain, 6).alias("gain"), seen.alias("seen")), "toxic-features")
    telling = [r["f"] for r in counts.where(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "f").limit(n_features).collect()]
    common = counts.where((F.col("seen") >= n / 100) & ~F.endswith("f", F.lit("*")) & (F.length("f") > 1))
    even = [r["f"] for r in common.orderBy("gain", F.desc("seen"), "f").limit(n_even).collect()]
    unstage(counts)
    return telling, [w for w in even if w not in set(telling)]


def counterfactuals(text: str | None, groups: list[tuple[str, ...]], even: set[str]) -> Iterator[tuple[str, str]]:
    """Pairs of sentences that differ in one word of a group only: two for each group that the text draws, at most one of either kind.

    `groups` hold the identity groups and last the corpus's own even words. The sentence,
    its slot and the terms are drawn by the text's hash.
    """
    slots = [(s, w) for s in _SENTENCE.findall((text or "").lower()) for w in _WORD.findall(s) if w in even]
    if not slots:
        return
    draw = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))
    sentence, slot = slots[draw % len(slots)]
    put = lambda term: _WORD.sub(lambda m: term if m[0] == slot else m[0], sentence)
    for group in (groups[draw // 7 % (len(groups) - 1)] if len(groups) > 1 else (), groups[-1]):
        if group:
            k = draw // 1009 % len(group)
            one, other = put(group[k]), put(group[(k + 1) % len(group)])
            yield sentence, one
            yield one, other


def fit(
    docs: DataFrame,
    labels: DataFrame,
    allowed: F.Column,
    max_rows: int = 20_000,
    max_pairs: int = 5_000,
    n_features: int = 600,
    least: int = 3,
    strength: float = 1.0,
    ridge: float = 1e-4,
    toxic_weight: float = 2.0,
    seed: int = 6,
    identity_groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS,
) -> ToxicityModel:
    """Fit on at most max_rows of the labels for which `allowed` (a condition on doc_id) holds."""
    with arrow_batches(docs.sparkSession, TEXTS):
        sample = stage(labelled_sample(docs, labels, allowed, max_rows, seed), "toxic-sample")
        model = _fit_sample(sample, max_pairs, n_features, least, strength, ridge, toxic_weight, identity_groups)
    unstage(sample)
    return model


def _fit_sample(sample: DataFrame, max_pairs: int, n_features: int, least: int, strength: float, ridge: float, toxic_weight: float, identity_groups: tuple[tuple[str, ...], ...]) -> ToxicityModel:
    swaps = {a: group[(i + 1) % len(group)] for group in identity_groups for i, a in enumerate(group)}
    telling, even = telling_features(sample, n_features, least)
    if not telling:
        share = sample.agg(F.avg("toxic")).first()[0]
        return ToxicityModel(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))) if share is not None else -700.0)
    # Identity terms and even words are always features, so that the penalty reaches them.
    features = list(dict.fromkeys([*telling, *(f for w in [*swaps, *even] for f in word_features(w))]))
    at = {f: i for i, f in enumerate(features)}
    groups, slots = [*identity_groups, tuple(even)], set(even)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lambda text: sorted(at[f] for f in text_features(text) if f in at)
        for frame in frames:
            out = []
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                out.append((0, int(toxic), known(text), []))
                for a, b in [*swapped_sentences(text, swaps), *counterfactuals(text, groups, slots)]:
                    a, b = known(a), known(b)
                    if a != b:
                        out.append((1, -1, a, b))
            yield pd.DataFrame(out, columns=["kind", "toxic", "on", "off"])

    found = sample.mapInPandas(rows, "kind int, toxic int, on array<int>, off array<int>")
    # Equal feature sets count together: far fewer rows reach the driver than were sampled.
    counted = stage(found.groupBy("kind", "toxic", "on", "off").agg(F.count(F.lit(1)).alias("n")), "toxic-rows")
    pairs = sorted(counted.where("kind = 1").orderBy(F.xxhash64("on", "off"), "on", "off").limit(max_pairs).collect(), key=lambda r: (r["on"], r["off"]))
    texts = sorted(counted.where("kind = 0").collect(), key=lambda r: (r["toxic"], r["on"]))
    unstage(counted)
    y = np.array([r["toxic"] for r in texts], dtype=float)
    n = np.array([r["n"] for r in texts]) * np.where(y == 1, toxic_weight, 1.0)
    times = np.array([r["n"] for r in pairs], dtype=float)
    x, a, b, number = _present(texts, "on", len(features)), _present(pairs, "on", len(features)), _present(pairs, "off", len(features)), len(pairs)
    del texts, pairs  # the driver keeps bytes only
    w = _descend(x, y, n, a, b, times, strength, ridge)
    return ToxicityModel(float(w[-1]), {f: float(v) for f, v in zip(features, w[:-1], strict=True) if abs(v) > 1e-9}, number)


def _present(rows: list, name: str, width: int) -> np.ndarray:
    """One row of zeros and ones each, and a last column of ones for the intercept."""
    x = np.zeros((len(rows), width + 1), np.uint8)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r[name]] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _blocks(*arrays: np.ndarray, rows: int = 2048) -> Iterator[tuple[np.ndarray, ...]]:
    """Doubles, block by block: only a block is ever held in that width."""
    for i in range(0, len(arrays[0]), rows):
        yield tuple(x[i : i + rows].astype(np.float64) for x in arrays)


def _descend(x: np.ndarray, y: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray, strength: float, ridge: float, steps: int = 40) -> np.ndarray:
    """Gauss-Newton steps on mean logistic loss + ridge + strength * mean squared score change of the pairs (a, b)."""
    share, total, pull = float((y * n).sum() / n.sum()), float(n.sum()), strength / max(1.0, float(times.sum()))
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 0
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))

    def loss(w: np.ndarray) -> float:
        out = float((keep * w * w).sum() / 2)
        for xs, ys, ns in _blocks(x, y, n):
            p = np.clip(_sigmoid(xs @ w), 1e-12, 1 - 1e-12)
            out -= float((ns * (ys * np.log(p) + (1 - ys) * np.log(1 - p))).sum()) / total
        for one, other, k in _blocks(a, b, times):
            out += pull * float((k * (_sigmoid(one @ w) - _sigmoid(other @ w)) ** 2).sum())
        return out

    now = loss(w)
    for _ in range(steps):
        slope, bend = keep * w, np.diag(keep + 1e-9)
        for xs, ys, ns in _blocks(x, y, n):
            p = _sigmoid(xs @ w)
            slope += xs.T @ (ns * (p - ys)) / total
            bend += (xs * (ns * p * (1 - p))[:, None]).T @ xs / total
        for one, other, k in _blocks(a, b, times):
            p, q = _sigmoid(one @ w), _sigmoid(other @ w)
            tilt = (p * (1 - p))[:, None] * one - (q * (1 - q))[:, None] * other
            slope += 2 * pull * tilt.T @ (k * (p - q))
            bend += 2 * pull * (tilt * k[:, None]).T @ tilt
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-7:
            step /= 2
        w, now = w - step, then
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_texts(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The `keep` columns and `score`, of every whole text."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for batch in texts:
            yield pd.Series([one(x) for x in batch], dtype="float64")
        del one
        give_back()

    return docs.select(*keep, score(F.coalesce(F.col("text"), F.lit(""))).alias("score"))


def in_fold(doc_id: F.Column, folds: int = 5) -> F.Column:
    """Whether a document is held out: crc32 of its id as text is divisible by `folds`."""
    return F.crc32(doc_id.cast("string")) % folds == 0


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out ones are never read."""
    model = fit(docs, labels, ~F.coalesce(in_fold(F.col("doc_id")), F.lit(False)))
    scored = score_texts(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(in_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns; no shuffle of texts."""
    model = fit(docs, labels, ~F.coalesce(in_fold(F.col("doc_id")), F.lit(False)))
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" if n.lower() == "score" else n for i, n in enumerate(names)])
    return score_texts(plain, model, plain.columns).where(F.col("score") < threshold).select(*plain.columns).toDF(*names)
