"""Compressing vectors to one code a part: Lloyd's rounds over distinct parts with weights.

Components become integers, floor(1024 * x), and vectors are cut into PARTS equal consecutive
parts. Each position has a codebook of its own, which starts with the parts of the first
vectors by id.

1. Equal parts of a position are counted into one row with a weight.
2. Each round assigns every distinct part to its nearest entry and sums parts times weights
   per entry; sums of tasks are added up by Spark, and the driver sees one row per entry.
3. The last codebooks give each distinct part a code and an error, and these are joined
   back to the vectors by the part itself.

All arithmetic is in whole numbers: in doubles where every intermediate is below 2^53,
otherwise in Python's integers, with the same results.

Scale: parts are pre-aggregated before their shuffle, so a vector that a third of all rows
share is a single distinct row, and hot parts are broadcast when codes are joined back (see
skew). The driver holds the codebooks, entries times width. Rounds read the staged
distinct rows, never the vectors.

Defined results: vectors that are null or hold null or non-finite components are dropped;
vectors of other lengths count as if filled up with zeros to the greatest length, made a
multiple of PARTS; components beyond 2^52 count as 2^52; rows with the same vec_id are rows
of their own, and those of the first ids are ordered by their components; a null vec_id
comes last; fewer vectors than entries make a shorter codebook; errors are capped to the
range of a long; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import arrow_batches, stage, unstage
from .skew import join_spread

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
MOST = 1 << 52
#: Cells of a block of distances, and bytes of an Arrow batch of vectors.
CELLS, BATCH_BYTES = 1 << 20, 1 << 22
_LONG = (1 << 63) - 1


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v: the vectors that take part, as doubles."""
    inf = F.lit(float("inf"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)
    return vectors.where(F.col("embedding").isNotNull()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where(F.forall("v", fine))


def whole_numbers(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * SCALE), -MOST, MOST).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per row of x the index of its nearest row of book, the lowest of equal ones, and the squared distance."""
    if small:
        c = book.astype(np.float64)
        half = (c * c).sum(axis=1)
        index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        step = max(1, CELLS // max(1, len(c)))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step].astype(np.float64)
            d = half[None, :] - 2 * (part @ c.T)
            at = d.argmin(axis=1)
            index[lo : lo + step] = at
            error[lo : lo + step] = (d[np.arange(len(part)), at] + (part * part).sum(axis=1)).astype(np.int64)
        return index, error
    rows, entries = x.astype(object), book.astype(object)
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    for k, entry in enumerate(entries):
        d = ((rows - entry) ** 2).sum(axis=1)
        better = d < error if k else np.ones(len(x), bool)
        index[better], error[better] = k, d[better]
    return index, error


class Codec:
    """The codebooks of all positions, and what a task needs to read distinct parts."""

    def __init__(self, books: list[np.ndarray], kind: str, small: bool):
        self.books, self.kind, self.small = books, kind, small

    def _blocks(self, frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(position, row numbers, parts) of each position in the batch."""
        position = frame["pos"].to_numpy()
        for p in np.unique(position):
            at = np.flatnonzero(position == p)
            width = self.books[p].shape[1]
            yield p, at, np.frombuffer(b"".join(frame["part"].iloc[at]), self.kind).reshape(len(at), width).astype(np.int64)

    def sums(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """pos, entry, n, sums: of all parts of the task, by their nearest entry."""
        number = np.int64 if self.small else object
        totals = [np.zeros((len(b), b.shape[1]), number) for b in self.books]
        counts = [np.zeros(len(b), np.int64) for b in self.books]
        for frame in frames:
            weights = frame["weight"].to_numpy(np.int64)
            for p, at, x in self._blocks(frame):
                index, _ = nearest(x, self.books[p], self.small)
                np.add.at(counts[p], index, weights[at])
                np.add.at(totals[p], index, x.astype(number) * weights[at].astype(number)[:, None])
        rows = [(p, k, int(counts[p][k]), [Decimal(int(s)) for s in totals[p][k]]) for p in range(len(self.books)) for k in np.flatnonzero(counts[p])]
        yield pd.DataFrame(rows, columns=["pos", "entry", "n", "sums"])

    def codes(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            code, error = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for p, at, x in self._blocks(frame):
                index, distance = nearest(x, self.books[p], self.small)
                code[at], error[at] = index, np.minimum(distance, _LONG).astype(np.int64)
            yield frame[["_key", "weight"]].assign(_code=code, _error=error)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()


def _next_books(distinct: DataFrame, codec: Codec) -> list[np.ndarray]:
    """Each entry's floor of the mean of its parts; unused entries stay."""
    width = codec.books[0].shape[1]
    per_task = distinct.mapInPandas(codec.sums, "pos int, entry int, n long, sums array<decimal(38,0)>")
    totals = per_task.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
    books = [b.copy() for b in codec.books]
    for row in totals.collect():  # an entry a row
        books[row["pos"]][row["entry"]] = [int(row[f"s{j}"]) // row["n"] for j in range(width)]
    return books


def compress_vectors(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: vec_id, code (two hex digits a part, so at most 256 entries), error, label_error, codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    rows = finite_vectors(vectors)
    n, longest, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    part = max(1, -(-(longest or 0) // PARTS))
    width, top = part * PARTS, min(MOST, int((most or 0.0) * SCALE) + 1)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    small = 8 * part * top * top < 1 << 53 and n * top < 1 << 62
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).toPandas()
    start = whole_numbers(first["v"].tolist(), width)
    codec = Codec([start[:, p * part : (p + 1) * part] for p in range(PARTS)], kind, small)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            m = whole_numbers(frame["v"].tolist(), width).astype(kind).reshape(len(frame), PARTS, part)
            yield frame[["vec_id", "label"]].assign(parts=[[x.tobytes() for x in v] for v in m])

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    with arrow_batches(spark, max(1, BATCH_BYTES // (8 * width))):
        whole = stage(rows.mapInPandas(cut, f"{fields}, parts array<binary>").withColumn("_row", F.monotonically_increasing_id()), "codes-vectors")
    apart = whole.select("_row", "vec_id", "label", F.posexplode("parts").alias("pos", "part"))
    apart = apart.withColumn("_key", F.concat(F.encode(F.col("pos").cast("string"), "UTF-8"), "part"))
    distinct = stage(apart.groupBy("_key", "pos", "part").agg(F.count(F.lit(1)).alias("weight")), "codes-distinct")
    for _ in range(rounds):
        codec = Codec(_next_books(distinct, codec), kind, small)
    coded = stage(distinct.mapInPandas(codec.codes, "_key binary, weight long, _code long, _error long"), "codes-distinct-codes")
    found = join_spread(apart.select("_row", "vec_id", "label", "pos", "_key"), coded, "_key", "weight")
    digits = F.lower(F.lpad(F.hex("_code"), 2, "0"))
    capped = lambda total: F.least(total, F.lit(_LONG).cast("decimal(38,0)")).cast("bigint")
    of_row = found.groupBy("_row", "vec_id", "label").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", digits.alias("hex")))), lambda x: x["hex"]), "").alias("code"),
        capped(F.sum(F.col("_error").cast("decimal(38,0)"))).alias("error"),
    )
    # A key that is never null: nulls are one label.
    out = stage(of_row.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes-rows")
    labels = out.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"), capped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    named = join_spread(out, stage(labels, "codes-labels"), "_label", "_n")
    unstage(whole, distinct, coded)
    return named.select("vec_id", "code", "error", "label_error", F.lit(codec.digest()).alias("codebooks_sha256"))
