"""Packing documents into fixed windows by minimum bin slack.

Every document is its token ids and a closing id. It is cut into full windows and a
remainder. Remainders are packed by minimum bin slack: the longest remaining length
opens a window, and a bitset subset-sum over the remaining lengths, each with its
count, finds the multiset that fills the window closest to its capacity; walking the
saved bitsets backwards gives the counts. The found multiset is used as often as the
counts allow.

Scale: planning needs only how many remainders have each length, at most `window`
rows however large the corpus, so the plan is made on the driver from that histogram
and has a few entries per length. Documents find their place by their exact rank
among equal lengths (bucketed offsets, see ranking), so a length that a third of all
documents share is spread over buckets. Texts never move: one pass turns them into
lengths and checksums, which are staged.

Ids are those of the tokenizers file. Texts are encoded by tiktoken, with the ranks that
the file's vocabulary holds, which is several times faster; stretches of LONG_PART
characters without a word's beginning go to tokenizers itself, since tiktoken's pattern
fails on very long white space. Tests hold the two against each other. "<|endoftext|>"
inside a text is its special id, as tokenizers has it.

Defined results: a null or empty text is the closing id alone; repeated rows are
documents of their own; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import arrow_batches, stage
from .ranking import add_group_ranks, bucket_of, shuffle_key
from .workers import give_back

WINDOW = 2048
CLOSING_ID = 1
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Characters of a stretch that tokenizers encodes, and of a run of shorter ones that tiktoken encodes together.
LONG_PART, RUN = 20_000, 1 << 20
#: Rows with a text in an Arrow batch.
TEXTS = 256
_CUT = re.compile(r" (?=\S)")


def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a byte-level vocabulary: printable bytes stand for themselves, the others from U+0100 on."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(byte_of[c] for c in token): number for token, number in vocabulary.items() if token != SPECIAL}


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes. A space before a visible character starts a token, so a text may be cut there."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={}).encode_ordinary

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plain(self, text: str) -> bytes:
        if len(text) < LONG_PART:
            return array("I", self.encode(text)).tobytes()
        ids, run, size = array("I"), [], 0
        first, *rest = _CUT.split(text)
        for part in (first, *(" " + x for x in rest)):
            if len(part) >= LONG_PART or size >= RUN:
                ids.extend(self.encode("".join(run)))
                run, size = [], 0
            if len(part) >= LONG_PART:
                ids.extend(self._library.encode(part, add_special_tokens=False).ids)
            else:
                run.append(part)
                size += len(part)
        ids.extend(self.encode("".join(run)))
        return ids.tobytes()

    def ids(self, text: str | None) -> bytes:
        parts = (text or "").split(SPECIAL)
        return np.array([SPECIAL_ID], dtype="<u4").tobytes().join(map(self._plain, parts))


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum comes closest to capacity from below.

    One bit per reachable sum. Counts enter in binary chunks, and the bitset before each
    chunk is kept, so that going back over the chunks recovers how many of each were used.
    """
    full, reach, mask = 1 << capacity, 1, (1 << (capacity + 1)) - 1
    trail: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(chunk, left)
            trail.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left, chunk = left - take, chunk * 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            at -= take * length
            used[length] = used.get(length, 0) + take
    return used


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """[(how many windows, {length: count in each})]; every application uses up a length."""
    left, plan = {k: v for k, v in histogram.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = best_fill({k: v for k, v in left.items() if v}, window - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[k] // n for k, n in fill.items())
        plan.append((times, fill))
        for k, n in fill.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


_PLAN = pa.schema([("_r", pa.int32()), ("_full_base", pa.int64()), ("_entries", pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "per", "sequence", "offset")])))])


def _placement(plan: list[tuple[int, dict[int, int]]]) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Per length its entries (first rank, how many per window, first sequence, offset), and the number of sequences."""
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, fill in plan:
        offset = 0
        for length in sorted(fill, reverse=True):
            entries.setdefault(length, []).append((used.get(length, 0), fill[length], sequence, offset))
            used[length] = used.get(length, 0) + fill[length] * times
            offset += fill[length] * length
        sequence += times
    return entries, sequence


def tokenized(docs: DataFrame, vocabulary: str, window: int, keep: list[str], closing_id: int = CLOSING_ID, shorter_first: bool = False) -> DataFrame:
    """The `keep` columns, doc_tokens and the crc32 of every piece of `window` ids; the shorter piece is the last one or, if asked, the first."""
    closing = np.array([closing_id], dtype="<u4").tobytes()

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = word_tokenizer(vocabulary).ids
        for frame in frames:
            lengths, sums = [], []
            for text in frame["_text"]:
                ids = ids_of(text) + closing
                first = len(ids) % (4 * window) if shorter_first else 0
                cuts = [0] * bool(first) + list(range(first, len(ids), 4 * window)) + [len(ids)]
                lengths.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
            yield frame.drop(columns="_text").assign(doc_tokens=lengths, ids_crc32s=sums)
        word_tokenizer.cache_clear()  # read again in a tenth of a second; an idle worker holds nothing
        del ids_of
        give_back()

    rows = docs.select(*keep, F.col("text").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInPandas(measure, f"{fields}, doc_tokens long, ids_crc32s array<long>")


def staged_lengths(docs: DataFrame, vocabulary: str, window: int, closing_id: int = CLOSING_ID, shorter_first: bool = False) -> DataFrame:
    """tokenized() once, with each document's place in a seeded order, its full pieces (_full) and what remains (_rem)."""
    rows = tokenized(docs, vocabulary, window, ["doc_id"], closing_id, shorter_first)
    with arrow_batches(docs.sparkSession, TEXTS):
        rows = stage(rows.withColumn("_key", shuffle_key(1, "doc_id")), "pack-lengths")
    rows = rows.withColumn("_rem", (F.col("doc_tokens") % window).cast("int")).withColumn("_full", F.floor(F.col("doc_tokens") / window).cast("bigint"))
    return rows.withColumn("_bucket", bucket_of(F.col("_key")))


def place_remainders(rows: DataFrame, plan_of: Callable[[dict[int, int]], list[tuple[int, dict[int, int]]]]) -> DataFrame:
    """rows with _sequence and _offset of their remainder by the plan of its histogram, and _first_full, the sequence of their first full piece."""
    # At most `window` rows: how many documents have each remainder.
    histogram = {r["_rem"]: (r["n"], r["f"]) for r in rows.groupBy("_rem").agg(F.count(F.lit(1)).alias("n"), F.sum("_full").alias("f")).collect()}
    entries, sequences = _placement(plan_of({k: n for k, (n, _) in histogram.items() if k}))
    table, full_base = [], sequences
    for rem in sorted(histogram):
        table.append((rem, full_base, [dict(zip(("first", "per", "sequence", "offset"), e, strict=True)) for e in entries.get(rem, [])]))
        full_base += histogram[rem][1]
    # By Arrow: rows of Python objects would start workers of their own.
    plan = pa.table(list(zip(*table, strict=True)) or [[], [], []], schema=_PLAN)
    plan = rows.sparkSession.createDataFrame(plan)
    ranked = add_group_ranks(rows, ["_rem"], "_key", ["doc_id", "doc_tokens"], "_rank", {"_full": "_full_before"})
    placed = ranked.join(F.broadcast(plan), F.col("_rem") == F.col("_r"))
    rank = F.col("_rank") - 1
    placed = placed.withColumn("_e", F.try_element_at(F.filter("_entries", lambda e: e["first"] <= rank), F.lit(-1)))
    inside = rank - F.col("_e.first")
    sequence = (F.col("_e.sequence") + F.floor(inside / F.col("_e.per")).cast("bigint")).alias("_sequence")
    offset = (F.col("_e.offset") + (inside % F.col("_e.per")) * F.col("_rem")).cast("bigint").alias("_offset")
    return placed.select("doc_id", "doc_tokens", "ids_crc32s", "_rem", "_full", (F.col("_full_base") + F.col("_full_before")).cast("bigint").alias("_first_full"), sequence, offset)


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    placed = place_remainders(staged_lengths(docs, vocabulary, window), lambda histogram: plan_windows(histogram, window))
    tail = F.struct(
        (F.col("_full") * window).alias("start"),
        F.col("_rem").cast("bigint").alias("length"),
        F.element_at("ids_crc32s", -1).alias("ids_crc32"),
        F.col("_sequence").alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )
    fulls = F.transform(
        F.slice("ids_crc32s", F.lit(1), F.col("_full").cast("int")),
        lambda crc, i: F.struct(
            (i * window).cast("bigint").alias("start"),
            F.lit(window).cast("bigint").alias("length"),
            crc.alias("ids_crc32"),
            (F.col("_first_full") + i).cast("bigint").alias("sequence_id"),
            F.lit(0).cast("bigint").alias("offset"),
        ),
    )
    pieces = F.when(F.col("_rem") > 0, F.concat(fulls, F.array(tail))).otherwise(fulls)
    return placed.select("doc_id", "doc_tokens", F.explode(pieces).alias("p")).select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")
