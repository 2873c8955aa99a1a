"""Exact top-k inner products over vectors sorted by length.

Components are first turned into floor(1024 * x), so scores are integers. Vectors
are dealt into blocks by descending length (range partitioned, never one sort) and
rotated once, when their block is packed. The rotation is the right singular basis of a
bounded sample of vectors: any rotation keeps inner products, this one puts most of a
vector into its first coordinates.

1. Some vectors - the longest and the sample - are scored for every query; the k-th best
   of these is a lower bound of the query's final k-th score.
2. A block meets a group of query blocks only if the greatest length in it can still reach the
   group's lowest bound per unit of query length (Cauchy-Schwarz).
3. Blocks are dealt to stripes in turn, so that each begins with long vectors. Inside a
   stripe a block of queries goes through the blocks in descending length. At several
   cuts the partial sum over the leading rotated coordinates plus the product of the
   residual lengths bounds each score from above; pairs below the query's bound are
   dropped, the survivors of the last cut are scored exactly, and each query's k-th best
   so far is its bound for the next block.

Queries are a stated set against all rows, in blocks: only keys and bounds decide which
blocks meet. Partial sums are kept in single precision, so bounds carry a relative slack
above its rounding, which grows with the width; pruning never loses a result.

Scale: the sample and the seeds have fixed sizes; all other data stays in tables. Blocks
and stripes have fixed sizes in bytes, whatever the width of the vectors.

Defined results: vectors that are null or hold null or non-finite components take no
part; vectors of other lengths count as if filled up with zeros; a row is never its own
candidate, nor are rows with the same vec_id; repeated rows of other ids are
candidates each; ties go to the smaller vec_id; fewer than k candidates give all of
them; scores are exact, and capped to the range of a long; empty tables give no
rows; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import arrow_batches, stage, unstage
from .skew import small_or_joined

SCALE = 1024
#: Components of a block of queries, and of vectors; blocks of vectors in a stripe, and of queries in a group: a task meets a stripe and a group.
QUERY_BLOCK, VECTOR_BLOCK, STRIPE, GROUP = 1 << 17, 1 << 16, 32, 16
#: Fixed numbers of vectors that go to the driver.
SAMPLE, SEEDS = 2048, 1024
#: Shares of the coordinates after which pairs are dropped: of whole blocks, then of single pairs.
WHOLE_CUTS, PAIR_CUTS = (0.5, 0.75), (0.875,)
_SLACK = 1e-5


def _slack(width: int) -> float:
    """A bound of the relative rounding of a single-precision sum of that many products."""
    return max(_SLACK, width * 2.0**-22)


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of whole doubles), norm: of the vectors that take part."""
    inf = F.lit(float("inf"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)
    rows = vectors.where(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.forall("e", fine))
    whole = lambda x: F.when(F.abs(x) < 1e15, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)
    rows = rows.select("vec_id", F.transform("e", whole).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("vec_id", "v", length.alias("norm"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of q with those of c, one by one, as int64."""
    top = np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * max(1, q.shape[1])
    if top < 2**53:
        return np.rint(np.einsum("ij,ij->i", q, c)).astype(np.int64)
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for x, y in zip(q, c, strict=True)], np.int64)


def _first_bounds(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Per query a lower bound of its k-th best score, from these vectors of different ids; -inf with fewer than k."""
    if len(c) <= k:
        return np.full(len(q), -np.inf)
    s = q @ c.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    return kth - np.abs(kth) * 1e-9 - 1


class Block:
    """Vectors with their ids: whole numbers, rotated in single precision, and lengths left behind each cut."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, rotated: np.ndarray):
        self.ids, self.whole, self.rotated = ids, whole, rotated
        squares = np.cumsum(rotated[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1]
        self.left = np.sqrt(np.hstack([squares, np.zeros((len(ids), 1))])).astype(np.float32)
        self.norm = self.left[:, 0]

    @classmethod
    def read(cls, ids: bytes, whole: bytes, rotated: bytes, width: int, kind: str) -> Block:
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(whole, kind).reshape(-1, width), np.frombuffer(rotated, np.float32).reshape(-1, width))


def search(q: Block, bounds: np.ndarray, blocks: Iterator[Block], k: int, unit: float = 1.0, rows: int = 256) -> tuple[pd.DataFrame, int]:
    """The k best of all blocks for every query, and how many pairs were scored in full.

    Blocks come in descending length; rotated coordinates are in multiples of `unit`.
    """
    width, n = q.rotated.shape[1], len(q.ids)
    bounds = bounds.astype(np.float64).copy()
    best = pd.DataFrame({"at": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64)})
    slack = _slack(width)
    whole_cuts = sorted({max(1, int(width * x)) for x in WHOLE_CUTS})
    pair_cuts = sorted({int(width * x) for x in PAIR_CUTS} - {0, *whole_cuts})
    scored = 0
    for block in blocks:
        longest = float(block.norm.max(initial=0.0))
        live = np.flatnonzero(q.norm.astype(np.float64) * longest * (1 + slack) + 1 >= bounds / unit**2)
        fresh = []
        for at in (live[i : i + rows] for i in range(0, len(live), rows)):
            limit = (bounds[at] / unit**2).astype(np.float32)[:, None]
            # A bound is never rounded up, and partial sums get the slack of single precision.
            room = np.float32(slack) * np.outer(q.norm[at], block.norm) + 1 + np.abs(limit) * np.float32(1e-6)
            partial, begin = np.zeros((len(at), len(block.ids)), np.float32), 0
            alive = q.ids[at][:, None] != block.ids[None, :]
            for cut in whole_cuts:
                partial += q.rotated[at, begin:cut] @ block.rotated[:, begin:cut].T
                alive &= partial + np.outer(q.left[at, cut], block.left[:, cut]) + room >= limit
                begin = cut
                if not alive.any():
                    break
            i, j = np.nonzero(alive)
            done = partial[i, j]
            for cut in pair_cuts:
                done = done + np.einsum("ij,ij->i", q.rotated[at[i], begin:cut], block.rotated[j, begin:cut])
                keep = done + q.left[at[i], cut] * block.left[j, cut] + room[i, j] >= limit[i, 0]
                i, j, done, begin = i[keep], j[keep], done[keep], cut
            scored += len(i)
            for lo in range(0, len(i), 1 << 15):
                a, b = at[i[lo : lo + (1 << 15)]], j[lo : lo + (1 << 15)]
                s = _exact(q.whole[a].astype(np.float64), block.whole[b].astype(np.float64))
                good = s >= bounds[a]
                fresh.append(pd.DataFrame({"at": a[good], "score": s[good], "vec_id": block.ids[b[good]]}))
        if not fresh:
            continue
        best = pd.concat([best, *fresh], ignore_index=True).sort_values(["at", "score", "vec_id"], ascending=[True, False, True], ignore_index=True)
        place = best.groupby("at").cumcount()
        best = best[place < k].reset_index(drop=True)
        full = best[place[place < k].to_numpy() == k - 1]
        bounds[full["at"]] = np.maximum(bounds[full["at"]], full["score"].to_numpy(np.float64) - np.abs(full["score"].to_numpy(np.float64)) * 1e-15)
    return best, scored


def top_k(vectors: DataFrame, queries: F.Column, k: int = 10) -> DataFrame:
    """The k best of all vectors for each row that `queries` holds for: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = stage(integer_vectors(vectors), "mips-vectors")
    n_queries, n_rows, width, most = rows.agg(F.count_if(queries), F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width, kind = max(1, width), "<i4" if (most or 0) < 2**31 else "<f8"
    unit = 1.0 if kind == "<i4" else most / 2**20
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    basis = np.linalg.svd(_matrix(sample["v"].tolist(), width), full_matrices=True)[2].T
    seeds = pd.concat([rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).toPandas(), sample]).drop_duplicates("vec_id")
    seed_ids, seed = seeds["vec_id"].to_numpy(np.int64), _matrix(seeds["v"].tolist(), width)
    query_rows, vector_rows = (max(1, x // width) for x in (QUERY_BLOCK, VECTOR_BLOCK))

    def packed(part: pd.DataFrame) -> dict:
        m = _matrix(part["v"].tolist(), width)
        return {"ids": part["vec_id"].to_numpy(np.int64).tobytes(), "m": m.astype(kind).tobytes(), "r": (m @ basis / unit).astype(np.float32).tobytes()}

    def query_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            part, m = frame, _matrix(frame["v"].tolist(), width)
            bound = np.concatenate([_first_bounds(part["vec_id"].to_numpy(np.int64)[i : i + 512], m[i : i + 512], seed_ids, seed, k) for i in range(0, len(part), 512)])
            need = float(np.min(np.where(bound > 0, bound / np.maximum(part["norm"].to_numpy(float), 1e-300), -np.inf)))
            yield pd.DataFrame([packed(part) | {"bounds": bound.tobytes(), "need": need}])[["need", "ids", "m", "r", "bounds"]]

    def vector_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([packed(frame) | {"longest": float(frame["norm"].max())}])[["longest", "ids", "m", "r"]]

    # An Arrow batch is a block. Queries of like length share one.
    q = rows.where(queries)
    q = q.repartitionByRange(max(1, -(-n_queries // (8 * query_rows))), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    with arrow_batches(spark, query_rows):
        q = asked = stage(q.mapInPandas(query_blocks, "need double, ids binary, m binary, r binary, bounds binary").withColumn("qb", F.monotonically_increasing_id()), "mips-queries")
    c = rows.repartitionByRange(max(1, -(-n_rows // (4 * vector_rows))), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    with arrow_batches(spark, vector_rows):
        c = blocks = stage(c.mapInPandas(vector_blocks, "longest double, ids binary, m binary, r binary").withColumn("cb", F.monotonically_increasing_id()), "mips-blocks")
    stripes = max(1, -(-c.count() // STRIPE))
    # The upper bits of cb are the partition, in descending length; the lower ones the place in it.
    c = c.withColumn("_stripe", F.pmod(F.shiftright("cb", 33) * 7 + F.col("cb").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(stripes)).cast("int"))
    # Neighbouring blocks of queries travel together, so a block of vectors is sent once a group.
    q = q.withColumn("qg", F.shiftleft(F.shiftright("qb", 33), 33) + F.floor(F.col("qb").bitwiseAND(F.lit((1 << 33) - 1)) / GROUP).cast("bigint"))
    needs = small_or_joined(q.groupBy(F.col("qg").alias("_qg")).agg(F.min("need").alias("need")))
    c = c.join(needs, F.col("longest") * (1 + _slack(width)) + unit >= F.col("need")).drop("need")
    q = q.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))

    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        ordered = right.sort_values(["longest", "cb"], ascending=[False, True])
        for one in left.itertuples() if len(right) else ():
            block = Block.read(one.ids, one.m, one.r, width, kind)
            best, _ = search(block, np.frombuffer(one.bounds), (Block.read(*x, width, kind) for x in zip(ordered["ids"], ordered["m"], ordered["r"], strict=True)), k, unit)
            out.append(pd.DataFrame({"query_id": block.ids[best["at"]], "vec_id": best["vec_id"], "score": best["score"]}))
        return pd.concat(out, ignore_index=True)

    met = q.groupBy("qg", "stripe").cogroup(c.groupBy("_qg", "_stripe")).applyInPandas(found, "query_id bigint, vec_id bigint, score bigint")
    with arrow_batches(spark, 64):
        met = stage(met, "mips-found")
    unstage(rows, blocks, asked)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
