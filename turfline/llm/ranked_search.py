"""Ranked lexical search over a tiered index: high-impact postings first, lower tiers only where proof is lacking.

A document's score for an item is the sum over the item's terms of w * f, where w falls
with the number of documents that hold the term, and f, the impact, rises with the term's
occurrences in the document and falls with its length; all in whole numbers (see `impacts`).

1. Texts are read once. A row a document keeps the numbers and occurrences of the terms that
   items ask for; the row is the document's posting list and the lowest tier.
2. A histogram of impacts per term gives each upper tier its bar: a posting belongs to it
   if its impact is above the bar, and the greatest impact up to the bar is what the term
   can still add below it. An upper tier holds the postings of a share of the documents per
   term, and again those of the tiers above it.
3. An upper tier gives each document a lower bound of its score (the postings seen) and an upper bound
   (and the bars of all others of the item's terms). The k-th best lower bound is the item's
   mark. If the bars alone stay under the mark, no unseen document can be among the k best: the item
   is proved, and the documents whose upper bound reaches the mark are scored in full.
4. Items without proof, and those with more candidates in a task than CANDIDATES, fall through to
   the next tier, at last to the whole rows, where every document is scored and each
   task keeps the k best of each item that reach its mark.

Scale: nothing is shuffled but histograms, the k best of tasks, and candidates. Items come in
blocks of bounded size, with all documents against each; a block's terms and weights are what
tasks hold beside their batch. Very long texts are cut at separators and counted in slices.

Defined results: a null or empty text or one without terms is no document; repeated rows, with
or without an id, are documents of their own; equal scores go by doc_id, then nulls, then by
position in the index; repeated items are ranked each; an item without terms, or whose terms
no document holds, gives no rows; empty tables give no rows; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import arrow_batches, stage, unstage
from .skew import small_or_joined
from .workers import give_back

#: Least and share of the documents whose postings of a term an upper tier holds.
TIERS = ((4_096, 1 / 50), (16_384, 1 / 6))
#: Steps of the histogram of impacts, which are at most MOST_IMPACT.
STEP, MOST_IMPACT = 2_000, 1_000_000
#: Documents of one task that may be candidates of an item.
CANDIDATES = 2_000
#: Terms of all items that are indexed together, and of a block of items that are scored together; items of such a block.
INDEX_TERMS, BLOCK_TERMS, BLOCK_ITEMS = 300_000, 16_000, 256
#: Bytes of a text that are counted together, texts of an Arrow batch, and rows of an index batch.
SLICE, TEXTS, ROWS = 1 << 20, 256, 4_096
#: Terms are runs of ASCII letters, digits and all other characters than ASCII; A-Z become lower case. In UTF-8 that is a table of bytes.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def term_counts(text: str | None) -> Counter:
    """{term in UTF-8: its occurrences} of the whole text."""
    raw, counts, at = (text or "").encode().translate(_TABLE), Counter(), 0
    while at < len(raw):
        cut = raw.find(b" ", at + SLICE)
        cut = len(raw) if cut < 0 else cut
        counts.update(raw[at:cut].split())
        at = cut
    return counts


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The impact of tf occurrences in a document of n terms; 64-bit integers."""
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * (25 + (75 * n * documents) // terms))


def weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


@dataclass
class Index:
    """rows: row, doc_id, n, terms, tfs of documents with a term; documents and terms: of all texts; holders and bars: by term number."""

    rows: DataFrame
    documents: int
    terms: int
    holders: np.ndarray
    bars: list[np.ndarray]
    tiers: list[DataFrame]

    def drop(self) -> None:
        unstage(self.rows, *self.tiers)


def _lists(values: list, offsets: list[int], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs: the length of each document, and its terms among `numbers` with their occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, tfs, offsets = [], [], [], [0]
            for text in batch.column("text"):
                counts = term_counts(text.as_py())
                lengths.append(counts.total())
                known = sorted((numbers[x], n) for x, n in counts.items() if x in numbers)
                terms += [x for x, _ in known]
                tfs += [n for _, n in known]
                offsets.append(len(terms))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), _lists(terms, offsets, pa.int32()), _lists(tfs, offsets, pa.int64())], ["doc_id", "n", "terms", "tfs"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def build_index(docs: DataFrame, numbers: dict[bytes, int]) -> Index:
    """The tiered index of all documents for the numbered terms."""
    spark = docs.sparkSession
    with arrow_batches(spark, TEXTS):
        rows = stage(counted(docs, numbers).where("n > 0").withColumn("row", F.monotonically_increasing_id()), "search-rows")
    documents, terms = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), F.sum("n")).first())
    holders, bars = np.zeros(len(numbers), np.int64), [np.zeros(len(numbers), np.int64) for _ in TIERS]
    if not documents:
        return Index(rows, 0, 0, holders, bars, [])
    postings = rows.select("n", F.inline(F.arrays_zip("terms", "tfs")))
    impact = F.expr(f"(1000000000L * tfs) div (1000L * tfs + 8L * (25L + (75L * n * {documents}L) div {terms}L))")
    steps = postings.select("terms", impact.alias("f")).groupBy("terms", F.floor(F.col("f") / STEP).alias("step")).agg(F.count(F.lit(1)).alias("held"), F.max("f").alias("most"))
    down = steps.withColumn("above", F.sum("held").over(Window.partitionBy("terms").orderBy(F.desc("step"))))
    sizes = [max(least, int(share * documents)) for least, share in TIERS]
    # A row a term.
    for row in down.groupBy("terms").agg(F.sum("held").alias("df"), *[F.max(F.when(F.col("above") > size, F.col("most"))).alias(f"bar{i}") for i, size in enumerate(sizes)]).toLocalIterator():
        holders[row["terms"]] = row["df"]
        for i in range(len(TIERS)):
            bars[i][row["terms"]] = row[f"bar{i}"] or 0
    index = Index(rows, documents, terms, holders, bars, [])
    for i in range(len(TIERS)):
        with arrow_batches(spark, ROWS):
            index.tiers.append(stage(_upper_tier(index, i), f"search-tier{i}"))
    return index


def _read(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    """The lists of a batch in one piece each, after their common offsets."""
    first = batch.column(names[0])
    offsets = first.offsets.to_numpy() - first.offsets[0].as_py()
    return [offsets, *[batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in names]]


def _row_impacts(batch: pa.RecordBatch, documents: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, term numbers, impacts) of a batch of whole rows."""
    offsets, ids, tfs = _read(batch, ("terms", "tfs"))
    n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), np.diff(offsets))
    return offsets, ids, impacts(tfs, n, documents, terms)


def _upper_tier(index: Index, i: int) -> DataFrame:
    """row, terms, fs: the postings above the tier's bars."""
    documents, terms, bar = index.documents, index.terms, index.bars[i]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, ids, f = _row_impacts(batch, documents, terms)
            keep = f > bar[ids]
            kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
            some = np.diff(kept) > 0
            cuts = np.concatenate([kept[:1], kept[1:][some]])
            arrays = [batch.column("row").filter(pa.array(some)), _lists(ids[keep], cuts, pa.int32()), _lists(f[keep], cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "terms", "fs"])

    return index.rows.select("row", "n", "terms", "tfs").mapInArrow(pick, "row long, terms array<int>, fs array<long>")


class Block:
    """A block of items: its terms by number, and how much an impact of each adds to each item."""

    def __init__(self, asked: pd.DataFrame, index: Index):
        """asked: item, term (a number), times."""
        self.items, columns = np.unique(asked["item"].to_numpy(), return_inverse=True)
        self.terms, lines = np.unique(asked["term"].to_numpy(), return_inverse=True)
        w = np.array([weight(index.documents, int(index.holders[t])) for t in self.terms], np.int64)
        adds = asked["times"].to_numpy(np.int64) * w[lines]
        # Doubles hold every sum exactly, unless an item is millions of terms long.
        small = np.bincount(columns, adds.astype(float)).max(initial=0) * MOST_IMPACT < 1 << 53
        self.adds = np.zeros((len(self.terms), len(self.items)), np.float64 if small else np.int64)
        self.adds[lines, columns] = adds
        self.line_of = np.full(len(index.holders), -1, np.int64)
        self.line_of[self.terms] = np.arange(len(self.terms))

    def scores(self, offsets: np.ndarray, ids: np.ndarray, values: list[np.ndarray], columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the batch, values x columns) of every document that holds a term of the block."""
        adds = self.adds[:, columns]
        lines = self.line_of[ids]
        known = lines >= 0
        bounds = np.concatenate([[0], np.cumsum(known)])[offsets]
        lines = lines[known]
        stacked = np.stack([v[known] for v in values]).astype(adds.dtype)
        for at in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[at], bounds[at + 1]
            yield int(at), stacked[:, a:b] @ adds[lines[a:b]]


class _Best:
    """The k best (score, then least doc_id) of each column, gathered document by document."""

    def __init__(self, marks: np.ndarray, k: int):
        self.k, self.marks, self.held = k, marks.astype(np.float64).copy(), [[] for _ in marks]

    def add(self, scores: np.ndarray, doc: tuple) -> None:
        for c in np.flatnonzero((scores >= self.marks) & (scores > 0)):
            held = self.held[c]
            held.append((int(scores[c]), *doc))
            if len(held) >= 4 * self.k:
                self._cut(c)

    def _cut(self, c: int) -> None:
        held = self.held[c] = sorted(self.held[c], key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))[: self.k]
        if len(held) == self.k:
            self.marks[c] = max(self.marks[c], held[-1][0])

    def rows(self) -> Iterator[tuple[int, tuple]]:
        for c in range(len(self.held)):
            self._cut(c)
            yield from ((c, x) for x in self.held[c])


_FOUND = "item long, doc_id long, score long, row long"
_NAMES = ["item", "doc_id", "score", "row"]


def _frame(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _lower_marks(tier: DataFrame, block: Block, columns: np.ndarray, k: int) -> np.ndarray:
    """Per column the k-th best lower bound of all documents, 0 with fewer."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Best(np.zeros(len(columns)), k)
        for batch in batches:
            offsets, ids, f = _read(batch, ("terms", "fs"))
            rows = batch.column("row").to_pylist()
            for at, (scores,) in block.scores(offsets, ids, [f], columns):
                held.add(scores, (None, rows[at]))
        yield _frame([(c, x[0]) for c, x in held.rows()], ["item", "score"])

    of_tasks = tier.mapInArrow(best, "item long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    marks = np.zeros(len(columns))
    for row in of_tasks.withColumn("p", place).where(F.col("p") <= k).where(F.col("p") == k).collect():  # a row an item of the block
        marks[row["item"]] = row["score"]
    return marks


def _candidates(tier: DataFrame, block: Block, columns: np.ndarray, bar: np.ndarray, rest: np.ndarray, marks: np.ndarray) -> DataFrame:
    """item, row of the documents whose upper bound reaches the mark and is above 0; row -1 for an item with more than CANDIDATES of them in a task."""

    least = np.maximum(marks, 1)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[int]] = [[] for _ in columns]
        for batch in batches:
            offsets, ids, f = _read(batch, ("terms", "fs"))
            rows = batch.column("row").to_pylist()
            for at, (over,) in block.scores(offsets, ids, [f - bar[ids]], columns):
                for c in np.flatnonzero(over + rest >= least):
                    if len(held[c]) <= CANDIDATES:
                        held[c].append(rows[at])
        found = [(int(columns[c]), row) for c, x in enumerate(held) for row in (x if len(x) <= CANDIDATES else [-1])]
        yield _frame(found, ["item", "row"])

    return tier.mapInArrow(reach, "item long, row long")


def _score_candidates(index: Index, block: Block, candidates: DataFrame) -> DataFrame:
    """The whole scores of the candidates: item (a column), doc_id, score, row."""
    documents, terms = index.documents, index.terms
    wanted = candidates.groupBy("row").agg(F.collect_list("item").alias("items"))
    rows = index.rows.join(small_or_joined(wanted), "row")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(block.items))
        for batch in batches:
            offsets, ids, f = _row_impacts(batch, documents, terms)
            rows, docs, items = (batch.column(x).to_pylist() for x in ("row", "doc_id", "items"))
            yield _frame([(c, docs[at], int(scores[c]), rows[at]) for at, (scores,) in block.scores(offsets, ids, [f], every) for c in items[at]], _NAMES)

    return rows.select("row", "doc_id", "n", "terms", "tfs", "items").mapInArrow(score, _FOUND)


def _score_all(index: Index, block: Block, columns: np.ndarray, marks: np.ndarray, k: int) -> DataFrame:
    """Every document's whole score, of which each task gives the k best per item that reach its mark."""
    documents, terms = index.documents, index.terms

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Best(marks, k)
        for batch in batches:
            offsets, ids, f = _row_impacts(batch, documents, terms)
            rows, docs = (batch.column(x).to_pylist() for x in ("row", "doc_id"))
            for at, (scores,) in block.scores(offsets, ids, [f], columns):
                held.add(scores, (docs[at], rows[at]))
        yield _frame([(int(columns[c]), doc, s, row) for c, (s, doc, row) in held.rows()], _NAMES)

    return index.rows.mapInArrow(score, _FOUND)


def search_block(index: Index, block: Block, k: int) -> tuple[list[DataFrame], list[int]]:
    """Tables of item (a column of the block), doc_id, score, row that hold the k best of each item, and how many items each tier proved."""
    left, marks, found, proved = np.arange(len(block.items)), np.zeros(len(block.items)), [], []
    for tier, bar in zip(index.tiers, index.bars, strict=True):
        if not len(left):
            break
        rest = (bar[block.terms].astype(block.adds.dtype) @ block.adds)[left].astype(np.float64)
        marks[left] = np.maximum(marks[left], _lower_marks(tier, block, left, k))
        sure = rest < marks[left]  # an unseen document that only ties might have the smaller id
        sure |= rest == 0
        columns = left[sure]
        if len(columns):
            near = stage(_candidates(tier, block, columns, bar, rest[sure], marks[columns]), "search-candidates")
            crowded = [r["item"] for r in near.where("row < 0").select("item").distinct().collect()]  # at most the items of the block
            found.append(_score_candidates(index, block, near.where(~F.col("item").isin(crowded)) if crowded else near))
            columns = np.setdiff1d(columns, crowded)
        proved.append(len(columns))
        left = np.setdiff1d(left, columns)
    if len(left):
        found.append(_score_all(index, block, left, marks[left], k))
    return found, [*proved, len(left)]


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number), item_id, term (its UTF-8), times: of the items that have terms."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, x, term, n) for i, x, text in zip(frame["item"], frame["item_id"], frame["text"], strict=True) for term, n in term_counts(text).items()]
            yield pd.DataFrame(rows, columns=["item", "item_id", "term", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    numbered = stage(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "search-items")
    return stage(numbered.mapInPandas(split, f"item long, item_id {kind}, term binary, times long"), "search-item-terms")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, report: list | None = None) -> DataFrame:
    """Each item's k best documents: item_id, rank, doc_id, score. report gets (items by the tier that proved them) per block."""
    spark = docs.sparkSession
    asked = item_terms(items)
    n_terms, n_items = asked.count(), asked.select("item").distinct().count()
    parts: list[DataFrame] = []
    indexes = max(1, -(-n_terms // INDEX_TERMS))
    blocks = max(1, -(-n_items // (indexes * BLOCK_ITEMS)), -(-n_terms // (indexes * BLOCK_TERMS)))
    place = F.pmod(F.xxhash64("item"), F.lit(indexes * blocks))
    for i in range(indexes):
        some = asked.where(F.pmod(place, F.lit(indexes)) == i)
        numbers = {bytes(r["term"]): at for at, r in enumerate(some.select("term").distinct().toLocalIterator())}
        if not numbers:
            continue
        index = build_index(docs, numbers)
        for b in range(blocks if index.documents else 0):
            rows = some.where(F.floor(place / indexes) == b).select("item", "term", "times").toPandas()
            if not len(rows):
                continue
            block = Block(rows.assign(term=[numbers[bytes(t)] for t in rows["term"]]), index)
            found, proved = search_block(index, block, k)
            if report is not None:
                report.append(proved)
            parts += [_numbered(spark, stage(x, "search-found"), block.items) for x in found]
        index.drop()
    names = asked.select("item", "item_id").distinct()
    if not parts:
        return names.limit(0).selectExpr("item_id", "1 AS rank", "0L AS doc_id", "0L AS score")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    best = every.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _numbered(spark: SparkSession, found: DataFrame, items: np.ndarray) -> DataFrame:
    """found with the items' own numbers in place of columns of the block."""
    table = spark.createDataFrame(pa.table({"_column": np.arange(len(items)), "_item": items.astype(np.int64)}))
    return found.join(F.broadcast(table), F.col("item") == F.col("_column")).select(F.col("_item").alias("item"), "doc_id", "score", "row")
