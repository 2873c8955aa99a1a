"""Best-two-fit packing: as few bins as can be, cutting only what no bin can hold.

Every document is its token ids and a closing id. One longer than a bin is cut into full
bins, and its first piece takes what is over. Bins are then filled one at a time: the
longest length left opens a bin, and the longest that still fits is added until none
does. While the bin has a gap and holds two documents or more, its smallest is put back
for two unpacked ones if these fill the widened gap more tightly; of such pairs the
tightest is taken, and among equal ones the one with the shortest document. Pairs of very short
documents would use up early what later bins need for their gaps, so a pair's
documents have a least length. The whole plan is made for several such lengths, and the one
with the fewest bins is kept; the last of them leaves no pair, which is first fit decreasing.

Scale: a plan depends on nothing but how many documents have each length, at most `capacity`
numbers however large the corpus, so it is made on the driver from that histogram; a bin
found is used as often as the counts allow, which gives the same bins as one at a
time. Documents find their place by their rank among equal lengths (see packing), so a
length that a third of all documents share is no single task. Texts never move.

Defined results: a null or empty text is the closing id alone; repeated rows, with or
without an id, are documents of their own; a document of exactly the capacity fills a bin;
an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import place_remainders, staged_lengths

CAPACITY = 1024
CLOSING_ID = 2
#: Least lengths of a pair's documents, as divisors of the capacity.
LEAST = (6, 4, 8, 12, 16, 32, 1)


def greedy_fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """{length: how many} of one bin: always the longest that is left and still fits."""
    lengths, gap, used = sorted(k for k, n in left.items() if n), capacity, {}
    while (at := bisect_right(lengths, gap)) > 0:
        longest = lengths[at - 1]
        used[longest] = min(left[longest], gap // longest)
        gap -= longest * used[longest]
        lengths = lengths[: at - 1]
    return used


def tightest_pair(left: dict[int, int], above: int, most: int, least: int = 1) -> tuple[int, int] | None:
    """Two of the lengths left, from `least` on, with the greatest sum of at most `most`, if that is over `above`; of equal sums the one with the shortest length."""
    lengths = sorted(k for k, n in left.items() if n and least <= k < most)
    low, high, best, pair = 0, len(lengths) - 1, above, None
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > most:
            high -= 1
            continue
        if total > best and (low < high or left[lengths[low]] > 1):
            best, pair = total, (lengths[low], lengths[high])
        low += 1
    return pair


def fill_bin(left: dict[int, int], capacity: int, least: int = 1) -> dict[int, int]:
    """{length: how many} of the next bin; `left` stays as it is."""
    used = greedy_fill(left, capacity)
    while (gap := capacity - sum(k * n for k, n in used.items())) > 0 and sum(used.values()) > 1:
        smallest = min(used)
        pair = tightest_pair({k: n - used.get(k, 0) for k, n in left.items()}, smallest, smallest + gap, least)
        if pair is None:
            break
        used[smallest] -= 1
        if not used[smallest]:
            del used[smallest]
        for length in pair:
            used[length] = used.get(length, 0) + 1
    return used


def plan_with(histogram: dict[int, int], capacity: int, least: int) -> list[tuple[int, dict[int, int]]]:
    """[(how many bins, {length: count in each})]; every entry uses up a length, or leaves less of it than a bin took."""
    left, plan = {k: n for k, n in histogram.items() if n}, []
    while left:
        used = fill_bin(left, capacity, least)
        times = min(left[k] // n for k, n in used.items())
        plan.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """The plan with the fewest bins over all LEAST; of equal ones the first."""
    plans = [plan_with(histogram, capacity, -(-capacity // n)) for n in LEAST]
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


def pack_two_fit(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = staged_lengths(docs, vocabulary, capacity, CLOSING_ID, shorter_first=True)
    placed = place_remainders(rows, lambda histogram: plan_bins(histogram, capacity))
    over = F.col("_rem") > 0
    first_full = over.cast("int")

    def piece(crc: F.Column, i: F.Column) -> F.Column:
        cut = over & (i == 0)
        return F.struct(
            i.alias("piece"),
            F.when(i == 0, 0).otherwise(F.col("_rem") + (i - first_full) * capacity).cast("bigint").alias("start"),
            F.when(cut, F.col("_rem")).otherwise(capacity).cast("bigint").alias("length"),
            crc.alias("ids_crc32"),
            F.when(cut, F.col("_sequence")).otherwise(F.col("_first_full") + i - first_full).cast("bigint").alias("sequence_id"),
            F.when(cut, F.col("_offset")).otherwise(0).cast("bigint").alias("offset"),
        )

    return placed.select("doc_id", F.explode(F.transform("ids_crc32s", piece)).alias("p")).select("doc_id", "p.*")
