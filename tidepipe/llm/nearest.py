"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors become int8 codes with a scale each, and what the codes miss becomes int8
codes of 254ths of it. Queries and candidates are dealt into
blocks of bounded bytes, and each pair of a query block and a candidate block is a
tile to which only codes travel. The product of two codes is off by at most what
the codes' rounding errors allow (Cauchy-Schwarz), so it bounds the inner product
from both sides, and a pair whose upper bound is under the k-th lower bound of its
query cannot be among the k nearest: first by the product of the tile's int8 codes,
then, for the pairs left, by the finer codes, then among all tiles. Only the pairs
that survive meet their original vectors; they are computed in double precision
and heaps merge them. The result is exact: recall 1.

Of equal vectors only the k + 1 of the smallest ids are candidates, as no query can
have more of them, so a vector that a third of the rows repeat costs nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Bytes of codes in a block of queries and of candidates, and candidates multiplied at a time.
QUERY_BYTES, CANDIDATE_BYTES, STRIP = 1 << 17, 1 << 20, 2048
#: Steps of the finer codes to one of the codes, and numbers of pairs that are refined at a time.
FINE, TOGETHER = 254, 1 << 21
#: Queries whose results leave a task together.
QUERIES = 1000
CODED = "id long, dim int, codes binary, fine binary, scale double, coded double, missed double, closer double, whole double"
CODED_NAMES = [c.split()[0] for c in CODED.split(", ")]
PAIRS = "query_id long, vec_id long, low double, high double"
#: Two lengths multiply to at most this, or products may overflow and their bounds say nothing.
SAFE = 1e300


def usable(vector: str) -> Column:
    """Not null, not all zero, and every component present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def length(v: np.ndarray) -> np.ndarray:
    """Of each row, without overflow on the way: infinite only where no double holds it."""
    most = np.maximum(np.abs(v).max(axis=1), np.finfo(np.float64).tiny)
    with np.errstate(over="ignore", under="ignore"):
        return most * np.linalg.norm(v / most[:, None], axis=1)


def quantise(v: np.ndarray) -> tuple[np.ndarray, ...]:
    """(codes, finer codes, scales, lengths of the coded vectors, lengths of what the codes miss, and of what the finer ones do)."""
    # Of vectors so short that the scale would underflow all codes are 0, and the bound is their length.
    scale = np.maximum(np.abs(v).max(axis=1) / 127, np.finfo(np.float64).tiny)[:, None]
    codes = np.rint(v / scale)
    fine = np.clip(np.rint((v / scale - codes) * FINE), -127, 127)
    return codes.astype(np.int8), fine.astype(np.int8), scale[:, 0], length(codes * scale), length(v - codes * scale), length(v - (codes + fine / FINE) * scale)


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CODED for (id, dim, v); vectors of one dimension at a time."""
    for batch in batches:
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims):
            own = batch.filter(pa.array(dims == dim))
            v = own["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            codes, fine, *numbers = quantise(v)
            packed = [pa.array([c.tobytes() for c in x], pa.binary()) for x in (codes, fine)]
            columns = [own["id"], own["dim"], *packed, *map(pa.array, (*numbers, length(v)))]
            yield pa.RecordBatch.from_arrays(columns, names=CODED_NAMES)


class Block:
    """The rows of one side of a tile as arrays."""

    def __init__(self, rows: pd.DataFrame, exact: type):
        self.ids, dim = rows["id"].to_numpy(), int(rows["dim"].iloc[0])
        self.codes, self.fine = (np.frombuffer(b"".join(rows[c]), np.int8).reshape(-1, dim).astype(exact) for c in ("codes", "fine"))
        self.scale, self.coded, self.missed, self.closer, self.whole = (rows[c].to_numpy(dtype=np.float64) for c in ("scale", "coded", "missed", "closer", "whole"))


def bounds(rough: np.ndarray, a_coded, a_missed, a_whole, b_missed, b_whole) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of inner products of which ``rough`` is that of the codes. Where a double may not hold it they say nothing."""
    most = a_whole * b_whole
    slack = (a_coded * b_missed + a_missed * b_whole) * (1 + 1e-9) + 1e-12 * most
    unsure = ~(most < SAFE)
    return np.where(unsure, -np.inf, rough - slack), np.where(unsure, np.inf, rough + slack)


def refined(q: Block, c: Block, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the pairs (i, j) by the finer codes."""
    rough = np.empty(len(i))
    step = max(1, TOGETHER // q.codes.shape[1])
    a, b = q.codes.astype(np.float64) + q.fine / FINE, c.codes.astype(np.float64) + c.fine / FINE
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        rough[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]])
    rough *= q.scale[i] * c.scale[j]
    return bounds(rough, q.coded[i] + q.missed[i], q.closer[i], q.whole[i], c.closer[j], c.whole[j])


def tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The pairs of a tile that may be among a query's k nearest, with the bounds of their inner products.

    Codes multiply as floats, in which sums of int8 products are exact: NumPy has
    no faster product of integers.
    """
    exact = np.float32 if queries["dim"].iloc[0] <= 1000 else np.float64
    q = Block(queries, exact)
    floor = np.full(len(q.ids), -np.inf)
    found = []
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for at in range(0, len(candidates), STRIP):
            c = Block(candidates.iloc[at : at + STRIP], exact)
            rough = (q.codes @ c.codes.T).astype(np.float64) * (q.scale[:, None] * c.scale[None, :])
            low, high = bounds(rough, q.coded[:, None], q.missed[:, None], q.whole[:, None], c.missed[None, :], c.whole[None, :])
            other = q.ids[:, None] != c.ids[None, :]
            if len(c.ids) > k:
                floor = np.maximum(floor, np.partition(np.where(other, low, -np.inf), len(c.ids) - k, axis=1)[:, len(c.ids) - k])
            i, j = np.nonzero(other & (high >= floor[:, None]))
            found.append((i, c.ids[j], *refined(q, c, i, j)))
    i, vec, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-low, i))
    i, vec, low, high = i[order], vec[order], low[order], high[order]
    first = np.searchsorted(i, np.arange(len(q.ids) + 1))
    kth = np.flatnonzero(np.diff(first) >= k)
    floor[kth] = np.maximum(floor[kth], low[first[kth] + k - 1])
    near = high >= floor[i]
    return pd.DataFrame({"query_id": q.ids[i[near]], "vec_id": vec[near], "low": low[near], "high": high[near]})


def kth_low(k: int):
    """Over whole queries, sorted by query: the k-th highest lower bound of each, or none of a query that has fewer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batched(heaps(batches, k, lambda b: b["low"].tolist()), QUERIES):
            yield pd.DataFrame({"query_id": [q for q, _ in some], "floor": [heap[0] if len(heap) == k else -np.inf for _, heap in some]})

    return run


def heaps(batches: Iterator[pd.DataFrame], k: int, keys) -> Iterator[tuple[int, list]]:
    """(query, heap of its k greatest keys) over rows sorted by query."""
    last, heap = None, []
    for batch in batches:
        for query, key in zip(batch["query_id"].tolist(), keys(batch), strict=True):
            if query != last:
                if last is not None:
                    yield last, heap
                last, heap = query, []
            if len(heap) < k:
                heapq.heappush(heap, key)
            elif key > heap[0]:
                heapq.heapreplace(heap, key)
    if last is not None:
        yield last, heap


def score_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner products in double precision, one component after the other, as a plain sum is defined."""
    for batch in batches:
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims):
            own = batch.filter(pa.array(dims == dim))
            a, b = (own[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in ("a", "b"))
            score = np.zeros(len(own))
            with np.errstate(over="ignore", invalid="ignore"):
                for d in range(dim):
                    score += a[:, d] * b[:, d]
            yield pa.RecordBatch.from_arrays([own["query_id"], own["vec_id"], pa.array(score)], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest by inner product of each query row: ``query_id, rank, vec_id, score``.

    Candidates are all rows but the query's own; a row is known by its id, so rows
    that repeat an id are one vector (of these, the first by components). Vectors
    that are null, zero or hold null or non-finite components take no part, nor do
    null ids. Vectors meet those of their own dimension only. Ties go to the
    smaller id; a query with under k candidates gets them all, one with none no
    row. A product that no double holds is infinite, or NaN where infinities
    cancel, and NaN ranks above all, as in Spark's own order. An empty table gives
    an empty result. Extra columns are ignored.

    A block holds QUERY_BYTES or CANDIDATE_BYTES of codes whatever the dimension,
    so a tile's memory is bounded; a candidate travels as 2 dim + 60 bytes once for
    each block of queries.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = materialize(rows.withColumn("dim", F.size("v")), "vectors")
    # A row a dimension: how many blocks its queries and its candidates make.
    n = F.count(F.lit(1))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count_if("q") * F.col("dim") / QUERY_BYTES).cast("int").alias("q_blocks"), F.ceil(n * F.col("dim") / CANDIDATE_BYTES).cast("int").alias("c_blocks"))
    # Of equal vectors no query can have more than k besides itself. Spark limits the groups before it shuffles them.
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)

    def dealt(side: DataFrame, seed: int, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        coded = side.select("id", "dim", "v").mapInArrow(encode, CODED).join(sizes, "dim").where("q_blocks > 0")
        block = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(own_blocks)).cast("int")
        return coded.select(*CODED_NAMES, block.alias(own), F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)).alias(other))

    queries = dealt(rows.where("q"), 1, "qb", "q_blocks", "cb", "c_blocks")
    candidates = dealt(first, 2, "cb", "c_blocks", "qb", "q_blocks")

    def best_of(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "low": [], "high": []})
        return tile(q, c, k)

    key = ["dim", "qb", "cb"]
    pairs = materialize(queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(best_of, PAIRS), "pairs")
    parts = shuffle_partitions(spark)
    lows = pairs.select("query_id", "low").repartition(parts, "query_id").sortWithinPartitions("query_id")
    floors = lows.mapInPandas(kth_low(k), "query_id long, floor double")
    survivors = pairs.join(floors, "query_id").where("high >= floor").select("query_id", "vec_id")
    own, other = rows.select(F.col("id").alias("query_id"), F.col("v").alias("a"), "dim"), rows.select(F.col("id").alias("vec_id"), F.col("v").alias("b"))
    scored = survivors.join(own, "query_id").join(other, "vec_id").select("query_id", "vec_id", "dim", "a", "b").mapInArrow(score_pairs, "query_id long, vec_id long, score double")

    def keys(batch: pd.DataFrame) -> list[tuple]:
        """Heaps order by score, NaN first, then by the smaller id."""
        x = batch["score"].to_numpy(dtype=np.float64)
        return list(zip(np.isnan(x).tolist(), np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf).tolist(), (-batch["vec_id"]).tolist(), strict=True))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batched(heaps(batches, k, keys), QUERIES):
            rows = [(q, i, -minus, np.nan if odd else x) for q, heap in some for i, (odd, x, minus) in enumerate(sorted(heap, reverse=True), 1)]
            yield pd.DataFrame.from_records(rows, columns=["query_id", "rank", "vec_id", "score"])

    return scored.repartition(parts, "query_id").sortWithinPartitions("query_id").mapInPandas(merge, "query_id long, rank int, vec_id long, score double")
