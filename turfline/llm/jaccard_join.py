"""N-gram Jaccard join by grouped prefixes, down to connected components.

1. Shingles. One pass over whole texts turns batches of documents into sorted sets of
   64-bit shingle hashes. A batch keeps its sizes and set digests at home and sends out,
   by hash bucket, its distinct shingles with their counts and the documents that hold
   them. A shingle that many documents of a batch share is sent as a count alone, so a
   shingle in a third of all documents is one entry per batch, not a hot key.
2. Frequencies. A bucket adds up how many documents hold each shingle, batch by batch, and
   answers the batches, for shingles held twice or more. (Buckets see the leading 48 bits
   of a hash at most: a collision may order two shingles alike, which costs a candidate and
   never a link.) There are as many buckets as the counted words ask for.
3. Classes. Documents with equal sets become one class; only its first row goes on.
4. Prefixes. In the order of frequency, rare first, two sets with Jaccard >= t share a
   shingle among their first n - ceil(t n) + 1. Shingles that only one document holds come
   first, so most documents end here, and shared passages, which are frequent, come last.
5. Groups. Classes with identical prefixes and size collapse into one group. Group
   pairs come from shared prefix shingles with the filters of size, place and bitmap: first
   every group against two hubs per shingle, and members against the first of their group.
   Verified links make components. Then, for shingles that still hold several
   components, all remaining pairs between different components are expanded to members,
   filtered and verified. They meet by shingle, size band and part of the holders, so a
   frequent shingle is spread over tasks. So no link between components is lost, and pairs
   inside a component are never enumerated.
6. Filters. Of two sets the places of the shared shingle bound what they can share, and so
   do their bitmaps: bit i is the parity of the shingles that hash to i, so two sets differ
   in at least as many shingles as their bitmaps do in bits. Both are exact bounds.
7. Verification compares whole 64-bit sets, computed again for candidates only.

Defined results: a null text, or one without words, has an empty set and is linked with
nothing, not even another such; fewer than five words are one shingle; repeated rows are
a class; a repeated doc_id with other text is a document of its own; an empty table
gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import arrow_batches, stage, unstage
from .graph import components
from .shingles import WordHashes, shingle_set
from .skew import BROADCAST_ROWS, beside_key, join_spread, small_or_joined
from .workers import give_back

#: Documents and shingles of a batch; documents must fit 16 bits.
BATCH_DOCS, BATCH_SHINGLES = 8192, 600_000
#: Shingles of a bucket, at most and roughly.
BUCKET_SHINGLES = 1_000_000
#: From this many documents of a batch, a shingle is sent as a count.
HOT = 16
#: Holders of a shingle that meet in one part.
PART = 2_000
#: Star rounds go on while shingles hold more pairs than this many times their holders, at most so often; the rest is done in full.
FEW, MOST_DRAWS = 50, 1
#: Rows with a text in an Arrow batch.
TEXTS = 256


def _planes(values: np.ndarray) -> bytes:
    """Ascending uint32 as byte planes of their differences: these compress."""
    return np.diff(values, prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(parts.T).view(np.uint32).ravel(), dtype=np.uint32)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        mixed = (tokens ^ (tokens >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return int(tokens.sum(dtype=np.uint64).view(np.int64)), int(mixed.sum(dtype=np.uint64).view(np.int64))


def _tail_bits(bits: int) -> int:
    """Bits of a shingle's hash that are kept inside a bucket; with the bucket's 48 at most."""
    return min(32, 48 - bits)


_SENT = "kind string, bucket int, batch long, a binary, b binary, c binary, d binary, e binary"


def _sent(batch: int, ids: list, hashes: list, sets: list[np.ndarray], bits: int) -> pd.DataFrame:
    """What one batch keeps at home (kind H) and sends to each bucket (kind S)."""
    sizes = np.array([len(s) for s in sets], np.int32)
    digests = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
    tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
    docs = np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
    tail = _tail_bits(bits)
    packed = np.sort(((tokens >> np.uint64(64 - bits - tail)) << np.uint64(16)) | docs)  # bucket and tail, then document
    keys, docs = packed >> np.uint64(16), (packed & np.uint64(0xFFFF)).astype(np.uint16)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    unique = keys[first]
    hot = counts >= HOT
    posted = np.repeat(~hot, counts)
    known = np.array([x if x is not None else 0 for x in ids], np.int64).tobytes() + np.array([x is None for x in ids], np.uint8).tobytes()
    rows = [("H", -1, batch, known, sizes.tobytes(), np.concatenate([digests.ravel(), np.array(hashes, np.int64)]).tobytes(), unique[hot].tobytes() + counts[hot].astype(np.uint64).tobytes(), docs[~posted].tobytes())]
    buckets, begin = np.unique((unique >> np.uint64(tail)).astype(np.int64), return_index=True)
    starts = np.concatenate([[0], np.cumsum(np.where(hot, 0, counts))])
    loose = docs[posted]
    for b, lo, hi in zip(buckets.tolist(), begin, np.append(begin[1:], len(unique)), strict=True):
        h = hot[lo:hi]
        tails = (unique[lo:hi] & np.uint64((1 << tail) - 1)).astype(np.uint32)
        rows.append(("S", b, batch, _planes(tails), np.where(h, 0, counts[lo:hi]).astype(np.uint8).tobytes(), loose[starts[lo] : starts[hi]].tobytes(), counts[lo:hi][h].astype(np.uint32).tobytes(), b""))
    return pd.DataFrame(rows, columns=["kind", "bucket", "batch", "a", "b", "c", "d", "e"])


def _send(docs: DataFrame, bits: int) -> DataFrame:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        ids, hashes, sets, held = [], [], [], 0
        known = WordHashes()
        for frame in frames:
            for doc_id, mark, text in zip(frame["doc_id"], frame["mark"], frame["text"], strict=True):
                s = shingle_set(text, hashes=known)
                if sets and (len(sets) >= BATCH_DOCS or held + len(s) > BATCH_SHINGLES):
                    yield _sent(number, ids, hashes, sets, bits)
                    number, ids, hashes, sets, held = number + 1, [], [], [], 0
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                hashes.append(mark)
                sets.append(s)
                held += len(s)
        if sets:
            yield _sent(number, ids, hashes, sets, bits)
        del ids, hashes, sets, known
        give_back()

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInPandas(batches, _SENT)


def _answers(bits: int):
    """Document frequencies of one bucket's shingles, told to the batches that hold them."""
    tail = np.uint64(_tail_bits(bits))

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, df, packed, bucket = np.zeros(0, np.uint32), np.zeros(0), [], 0
        for frame in frames:  # merged one by one: the packed rows stay, their sum is at most all distinct shingles
            bucket = int(frame["bucket"].iloc[0])
            tails, totals = [], []
            for row in zip(frame["batch"], frame["a"], frame["b"], frame["c"], frame["d"], strict=True):
                few = np.frombuffer(row[2], np.uint8).astype(np.float64)
                few[few == 0] = np.frombuffer(row[4], np.uint32)
                tails.append(_unplanes(row[1]))
                totals.append(few)
                packed.append(row[:4])
            keys, back = np.unique(np.concatenate([keys, *tails]), return_inverse=True)
            df = np.bincount(back, weights=np.concatenate([df, *totals]))
        high, out = np.uint64(bucket) << tail, []
        for batch, a, b, posted in packed:
            own, f = _unplanes(a), np.frombuffer(b, np.uint8).astype(np.int64)
            mine = df[np.searchsorted(keys, own)].astype(np.int64)
            names = high | own.astype(np.uint64)
            shared, hot = np.repeat(mine >= 2, f), f == 0
            docs = np.frombuffer(posted, np.uint16)[shared]
            if len(docs) or hot.any():
                out.append(("R", batch, np.repeat(names, f)[shared].tobytes(), np.repeat(mine, f)[shared].astype(np.int32).tobytes(), docs.tobytes(), names[hot].tobytes(), mine[hot].astype(np.int64).tobytes()))
            if len(out) == 64:
                yield pd.DataFrame(out, columns=["kind", "batch", "a", "b", "c", "d", "e"])
                out = []
        yield pd.DataFrame(out, columns=["kind", "batch", "a", "b", "c", "d", "e"])
        del keys, df, packed, out
        give_back()

    return answer


def _rows_at_home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples():
            sizes = np.frombuffer(r.b, np.int32)
            n = len(sizes)
            ids = np.frombuffer(r.a[: 8 * n], np.int64)
            null = np.frombuffer(r.a[8 * n :], np.uint8).astype(bool)
            rest = np.frombuffer(r.c, np.int64)
            yield pd.DataFrame(
                {"row": (np.int64(r.batch) << 16) + np.arange(n), "doc_id": pd.array(np.where(null, 0, ids), dtype="Int64"), "n": sizes.astype(np.int64), "d1": rest[: 2 * n : 2], "d2": rest[1 : 2 * n : 2], "mark": rest[2 * n :], "null": null}
            )


def _prefixes(num: int, den: int):
    """Rare-first prefixes of the classes of one batch: row, n, unique, prefix."""

    def of_batch(frame: pd.DataFrame) -> pd.DataFrame:
        home = frame[frame["kind"] == "H"].iloc[0]
        base = np.int64(home["batch"]) << 16
        sizes = np.frombuffer(home["b"], np.int32).astype(np.int64)
        first = np.zeros(len(sizes), bool)
        for x in frame.loc[frame["kind"] == "C", "a"]:
            first[np.frombuffer(x, np.int64) - base] = True
        told = frame[frame["kind"] == "R"]
        join = lambda name, kind: np.concatenate([*(np.frombuffer(x, kind) for x in told[name]), np.zeros(0, kind)])
        keys, df, docs = join("a", np.uint64), join("b", np.int32).astype(np.int64), join("c", np.uint16)
        hot = np.frombuffer(home["d"], np.uint64)
        if len(hot):
            names, counts = hot[: len(hot) // 2], hot[len(hot) // 2 :].astype(np.int64)
            asked = join("d", np.uint64)
            order = np.argsort(asked)
            hot_df = join("e", np.int64)[order][np.searchsorted(asked[order], names)]
            keys = np.concatenate([keys, np.repeat(names, counts)])
            df = np.concatenate([df, np.repeat(hot_df, counts)])
            docs = np.concatenate([docs, np.frombuffer(home["e"], np.uint16)])
        mine = first[docs]
        keys, df, docs = keys[mine], df[mine], docs[mine]
        order = np.lexsort((keys, df, docs))
        keys, docs = keys[order], docs[order].astype(np.int64)
        held = np.bincount(docs, minlength=len(sizes))
        unique = sizes - held
        take = np.clip(sizes - -(-num * sizes // den) + 1 - unique, 0, held)
        starts = np.concatenate([[0], np.cumsum(held)])
        some = np.flatnonzero((take > 0) & first)
        out = {"row": base + some, "n": sizes[some], "unique": unique[some], "prefix": pd.Series([keys[starts[i] : starts[i] + take[i]].view(np.int64) for i in some], dtype=object)}
        del told, keys, df, docs, mine, order
        give_back()
        return pd.DataFrame(out, columns=["row", "n", "unique", "prefix"])

    return of_batch


def _can_meet(num: int, den: int) -> F.Column:
    """Whether sets of n and m shingles that share the one at places `at` and `bt` may reach the threshold.

    Two sets that do share at least (n + m) t / (1 + t) shingles, so the first of them, in
    the common order, has that many places at and behind it in both. Sizes must fit too.
    """
    need = num * (F.col("n") + F.col("m"))
    room = ((F.col("n") - F.col("at")) * (num + den) >= need) & ((F.col("m") - F.col("bt")) * (num + den) >= need)
    return room & (F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of the shingles by hash: a power of two of bits, as many as shingles at least."""
    width = max(64, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((tokens % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_overlap(num: int, den: int) -> F.Column:
    """Whether sets with bitmaps x and y and sizes n and m may reach the threshold.

    They differ in at most (n + m) (1 - t) / (1 + t) shingles if they do. The longer bitmap
    is folded to the shorter: parities add up. Sizes differ by a factor of 1 / t at most, so do the
    powers of two that are not below them, and so many folds are enough.
    """
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), F.greatest(F.floor(F.size(x) / 2), F.lit(1)).cast("int")), F.slice(x, (F.floor(F.size(x) / 2) + 1).cast("int"), F.greatest(F.floor(F.size(x) / 2), F.lit(1)).cast("int")), lambda p, q: p.bitwiseXOR(q))
    x, y = F.col("x"), F.col("y")
    for _ in range(max(1, math.ceil(math.log2(den / num)))):
        x, y = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
    return apart * (num + den) <= (den - num) * (F.col("n") + F.col("m"))


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, tokens, bits of the wanted rows (row, doc_id, mark), computed from their whole texts."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for frame in frames:
            found = [shingle_set(x, hashes=known) for x in frame["text"]]
            yield pd.DataFrame({"row": frame["row"], "tokens": [x.tobytes() for x in found], "bits": [bitmap(x) for x in found]})
        known.clear()
        give_back()

    keys = small_or_joined(wanted.select("row", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")))
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    found = marked.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    # A repeated row is found as often as it is there; any one will do.
    return found.select("row", "text").mapInPandas(sets, "row long, tokens binary, bits array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have den * |both| >= num * |either|; staged."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield frame.loc[np.array(keep, bool), ["a", "b"]]
        give_back()

    # Only the sets of these pairs are shuffled, if the pairs' rows are few enough to broadcast.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    if pairs.count() * 2 <= BROADCAST_ROWS:
        sets = sets.join(F.broadcast(wanted), "row", "left_semi")
    bits = lambda a, x, n: sets.select(F.col("row").alias(a), F.col("bits").alias(x), (F.octet_length("tokens") / 8).cast("bigint").alias(n))
    likely = pairs.select("a", "b").join(bits("a", "x", "n"), "a").join(bits("b", "y", "m"), "b").where(_may_overlap(num, den)).select("a", "b")
    x = sets.select(F.col("row").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("row").alias("b"), F.col("tokens").alias("y"))
    with arrow_batches(pairs.sparkSession, 100):
        return stage(likely.join(x, "a").join(y, "b").mapInPandas(check, "a long, b long"), "jaccard-links")


def near_duplicate_rows(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """One row per input row: row (a key), doc_id, mark (xxhash64 of the text), n_shingles, component_id, stays.

    stays holds for one row of each component, the one of the smallest doc_id.
    """
    spark = docs.sparkSession
    blanks = F.length("text") - F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))  # a text has one word more at most
    shingles = docs.agg(F.sum(blanks + 1)).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, shingles / BUCKET_SHINGLES))), 3, 24))
    with arrow_batches(spark, TEXTS):
        sent = stage(_send(docs, bits), "jaccard-sent")
    with arrow_batches(spark, 64):
        told = sent.where("kind = 'S'").select("bucket", "batch", "a", "b", "c", "d").groupBy("bucket").applyInPandas(_answers(bits), "kind string, batch long, a binary, b binary, c binary, d binary, e binary")
        told = stage(told, "jaccard-told")
        home = sent.where("kind = 'H'").select("kind", "batch", "a", "b", "c", "d", "e")
        found = home.mapInPandas(_rows_at_home, "row long, doc_id long, n long, d1 long, d2 long, mark long, null boolean")
        found = stage(found.withColumn("doc_id", F.when(~F.col("null"), F.col("doc_id"))).drop("null"), "jaccard-rows")
    # Sets of two documents or more; all others, and empty ones, are classes of their own.
    classes = found.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    classes = stage(classes.select("first", "copies", F.struct("n", "d1", "d2").alias("set")), "jaccard-classes")
    rows = found.select("row", "doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.struct("n", "d1", "d2")).alias("set"))
    rows = join_spread(rows, classes, "set", "copies", "left").select("row", "doc_id", "mark", "n_shingles", F.coalesce("first", "row").alias("first"))
    rows = stage(rows, "jaccard-firsts")
    firsts = rows.where("row = first").groupBy(F.shiftright("row", 16).alias("batch")).agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def blob(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # a batch has at most BATCH_DOCS rows
        for frame in frames:
            yield pd.DataFrame({"batch": frame["batch"], "a": [np.asarray(x, np.int64).tobytes() for x in frame["rows"]]})

    none = [F.lit(None).cast("binary").alias(c) for c in "bcde"]
    with arrow_batches(spark, 64):
        firsts = firsts.mapInPandas(blob, "batch long, a binary").select(F.lit("C").alias("kind"), "batch", "a", *none)
        together = home.unionByName(told).unionByName(firsts)
        prefixes = stage(together.groupBy("batch").applyInPandas(_prefixes(num, den), "row long, n long, unique long, prefix array<long>"), "jaccard-prefixes")
    unstage(sent, told, found)
    links = _links(docs, rows, prefixes, num, den)
    linked = components(links)
    # How many rows meet in each class: classes of one row need no spreading.
    sizes = classes.select(F.col("first").alias("node"), "copies")
    linked = linked.join(sizes, "node", "left").select(F.col("node").alias("first"), "component", F.coalesce("copies", F.lit(1)).alias("copies"))
    joined = join_spread(rows, linked, "first", "copies", "left").withColumn("component", F.coalesce("component", "first"))
    joined = stage(joined.select("row", "doc_id", "mark", "n_shingles", "component"), "jaccard-components")
    unstage(prefixes, rows, classes, links)
    best = joined.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")).where("rows > 1")
    best = stage(best, "jaccard-best")
    joined = join_spread(joined, best, "component", "rows", "left")
    alone = F.col("best").isNull()
    return joined.select("row", "doc_id", "mark", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), (alone | (F.col("row") == F.col("best.row"))).alias("stays"))


def _pairs_with(near: DataFrame, hub: str, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of index rows and a hub beside them (row, n, at) that may reach the threshold."""
    pairs = near.where(f"row <> {hub}.row").select(F.least("row", f"{hub}.row").alias("a"), F.greatest("row", f"{hub}.row").alias("b"), "n", "at", F.col(f"{hub}.n").alias("m"), F.col(f"{hub}.at").alias("bt"))
    return pairs.where(_can_meet(num, den)).select("a", "b")


def _links(docs: DataFrame, rows: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """Verified pairs (a, b) of class rows whose components are those of all links; staged."""
    same = F.when(F.col("unique") == 0, F.xxhash64("prefix")).otherwise(F.col("row"))
    grouped = prefixes.withColumn("key", F.struct("n", (F.col("unique") == 0).alias("whole"), same.alias("value")))
    groups = stage(grouped.groupBy("key").agg(F.min("row").alias("group"), F.count(F.lit(1)).alias("members")), "jaccard-groups")
    members = stage(join_spread(grouped, groups, "key", "members").select("row", "group", "n", "unique", "prefix"), "jaccard-members")
    with arrow_batches(docs.sparkSession, TEXTS):
        sets = _whole_sets(docs, members.select("row").join(rows.select("row", "doc_id", "mark"), "row"))
        repeated = not rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        sets = stage(sets.dropDuplicates(["row"]) if repeated else sets, "jaccard-sets")
    index = members.select("row", "group", "n", "unique", F.posexplode("prefix").alias("pos", "token"))
    index = index.select("row", "group", "n", "token", (F.col("unique") + F.col("pos")).alias("at"))
    heads = index.where("row = group").select("row", "n", "at", "token")
    # Hubs of a shingle: the set that holds it earliest, having the fewest rare ones and so most in common, and the smallest set.
    place = F.struct("n", "row", "at")
    near = beside_key(heads, "token", {"near": F.min_by(place, F.struct("at", "row")), "small": F.min(place)})
    pairs = _pairs_with(near, "near", num, den).union(_pairs_with(near, "small", num, den))
    inside = members.where("row <> group").select(F.col("group").alias("a"), F.col("row").alias("b"))
    tried = stage(pairs.union(inside).distinct(), "jaccard-pairs")
    links = _verified(tried, sets, num, den)
    used, draw, index = [groups, members], 0, index.drop("group")
    while True:
        labels, draw = components(links), draw + 1
        apart = _apart(_labelled(index, labels), draw)
        unstage(labels, *used)
        left, pairs_left = apart.agg(F.count(F.lit(1)), F.sum(F.col("holders") - 1)).first()
        if not left or draw > MOST_DRAWS or pairs_left <= FEW * left:
            break
        # Another star round over what is still apart.
        more = _pairs_with(apart.where("hub.component <> component"), "hub", num, den).distinct().join(tried, ["a", "b"], "left_anti")
        more = stage(more, "jaccard-pairs")
        fresh = _verified(more, sets, num, den)
        used = [apart]
        tried, links, index = tried.union(more), links.union(fresh), apart.select("row", "n", "at", "token")
    if left:  # everything that remains between components
        rest = stage(_rest(apart, sets, num, den).join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        links = links.union(_verified(rest, sets, num, den))
    links = stage(links, "jaccard-links")
    unstage(apart, sets)
    return links


def _rest(apart: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs (a, b) between components that share a shingle and pass the filters, by shingle, size band and part."""
    wide = apart.join(sets.select("row", "bits"), "row")
    ratio = float(np.log(den / num)) * 1.005 if num < den else 1.0  # sets that may link lie in one band or in neighbours
    band, parts = F.floor(F.log("n") / ratio), F.ceil(F.col("holders") / PART).cast("int")
    left = wide.select("token", F.col("row").alias("a"), "n", "at", F.col("component").alias("ca"), F.col("bits").alias("x"), band.alias("low"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    left = left.withColumn("band", F.explode(F.array("low", F.col("low") + 1)))
    right = wide.select("token", F.col("row").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("component").alias("cb"), F.col("bits").alias("y"), band.alias("band"), F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"))
    pairs = left.join(right, ["token", "band", "part"]).where((F.col("ca") != F.col("cb")) & ((F.col("low") < F.col("band")) | (F.col("a") < F.col("b"))) & _can_meet(num, den)).where(_may_overlap(num, den))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled(index: DataFrame, labels: DataFrame) -> DataFrame:
    """index with the component of each row so far."""
    return index.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))


def _apart(index: DataFrame, draw: int) -> DataFrame:
    """Index rows of the shingles that hold several components, with the shingle's holders and a hub: the earliest in a drawn quarter of the sets; staged."""
    order = F.struct(F.pmod(F.xxhash64("row", F.lit(draw)), F.lit(4)), "at", "row")
    values = {"holders": F.count(F.lit(1)), "_lo": F.min("component"), "_hi": F.max("component"), "hub": F.min_by(F.struct("row", "n", "at", "component"), order)}
    return stage(beside_key(index, "token", values).where("_lo <> _hi").drop("_lo", "_hi"), "jaccard-apart")


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    return near_duplicate_rows(docs, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; all columns stay.

    Texts stay in place while the keys of the dropped rows, or of the kept ones, are few
    enough to broadcast; beyond that they are shuffled once, by id and hash.
    """
    rows = stage(near_duplicate_rows(docs, num, den), "jaccard-verdicts")
    ways = rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"), F.max("stays").alias("some"), F.min("stays").alias("all"))
    kept, dropped, repeated = ways.agg(F.count_if("some"), F.count_if(~F.col("some")), F.count_if(F.col("some") & (F.col("n") > 1))).first()
    fewer = rows.groupBy("doc_id", "mark").agg(F.max("stays").alias("some")).where(F.col("some") if kept <= dropped else ~F.col("some"))
    keys = small_or_joined(fewer.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")))
    on = docs["doc_id"].eqNullSafe(F.col("_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_mark"))
    found = docs.join(keys, on, "left_semi" if kept <= dropped else "left_anti")
    return found.dropDuplicates(["doc_id", "text"]) if repeated else found
