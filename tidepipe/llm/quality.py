"""Quality scores by Bradley-Terry pairwise ranking of text features.

Documents labelled 1 are preferred to those labelled 0; the chance that one is
preferred to another is the logistic of the difference of their scores, and a
score is linear in features of the text alone: shares of kinds of characters and
words, and how often words of each hash bucket occur. The
threshold is the quantile of the scores at the share of zeros among the training
labels.

All labelled rows that are not held out teach. They are dealt to blocks by a hash
of the id, and in a block every document of one class is compared with every one
of the other, so the pairs grow with the rows and not with their square; a table
of few labels is one block. Where one class is rare each of its documents stands in several
blocks, so that none lacks a partner. A round of Newton's method is one job that
sums slopes and curvatures over the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from .common import materialize, text_or_empty
from .textbatch import PrefixHash, mix, text_chunks, words

#: Preference pairs of a block whose classes are of one size.
PAIRS = 1 << 18
#: Rows of the rarer class in a block, or all of them; blocks in a file.
LEAST, TOGETHER = 64, 16
#: Shares of characters and words that a text is described by, and buckets of its hashed words.
SHARES, BUCKETS = 22, 64
FEATURES = SHARES + BUCKETS
#: Ridge of the shares and of the buckets, which are many and each say little.
RIDGE = np.repeat([1e-3, 5e-2], [SHARES, BUCKETS])
#: Rounds of Newton's method at most, and the step after which it has converged (the error left is of its square).
ROUNDS, SMALL = 30, 1e-5

LOWER, UPPER, DIGIT, SPACE, LINE, OTHER, MARKS = range(7)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[ord("a") : ord("z") + 1] = LOWER
KIND[ord("A") : ord("Z") + 1] = UPPER
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
KIND[ord("\n")] = LINE
KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'\"-"]] = MARKS


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each whole text; null is empty, and the empty text has a row too."""
    out = []
    for _, data, offsets in text_chunks(texts):
        start, stop, first = words(data, offsets)
        hashes = PrefixHash(data).of(start, stop)
        kinds = KIND[data]
        sums = np.zeros((7, len(data) + 1), dtype=np.int32)
        for k in range(7):
            np.cumsum(kinds == k, out=sums[k, 1:])
        ends = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(np.isin(data, (46, 33, 63)), out=ends[1:])
        width = np.diff(offsets)
        per = (sums[:, offsets[1:]] - sums[:, offsets[:-1]]) / np.maximum(width, 1)
        marked_words = np.concatenate([[0], np.cumsum(kinds[stop - 1] == MARKS)])
        lone_marks = np.concatenate([[0], np.cumsum((stop - start == 1) & (kinds[start] == MARKS))])
        caps = np.concatenate([[0], np.cumsum(sums[UPPER][stop] - sums[UPPER][start] > np.maximum(1, 0.5 * (stop - start)))])
        lengths = np.concatenate([[0], np.cumsum(stop - start)])
        for i in range(len(offsets) - 1):
            a, b = first[i], first[i + 1]
            n = b - a
            m = max(n, 1)
            _, counts = np.unique(hashes[a:b], return_counts=True)
            share = counts / m
            top = np.sort(share)[::-1]
            pairs = hashes[a : b - 1] * np.uint64(3) + hashes[a + 1 : b] if n > 1 else hashes[:0]
            buckets = np.bincount((mix(hashes[a:b]) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            out.append(
                [
                    np.log1p(n),
                    np.log1p(n) ** 2 / 10,
                    *per[[UPPER, DIGIT, SPACE, LINE, MARKS], i],
                    per[UPPER, i] / max(per[UPPER, i] + per[LOWER, i], 0.01),
                    np.sqrt(per[MARKS, i]),
                    np.sqrt(per[DIGIT, i]),
                    (marked_words[b] - marked_words[a]) / m,
                    (lone_marks[b] - lone_marks[a]) / m,
                    (caps[b] - caps[a]) / m,
                    (lengths[b] - lengths[a]) / m / 10,
                    len(counts) / m,
                    len(counts) / m * np.log1p(n),
                    float(-(share * np.log(share)).sum()) if n else 0.0,
                    float(top[:1].sum()),
                    float(top[:10].sum()),
                    len(np.unique(pairs)) / max(n - 1, 1),
                    (ends[offsets[i + 1]] - ends[offsets[i]]) / m,
                    float(n == 0),
                    *np.sqrt(buckets / m),
                ]
            )
    return np.array(out, dtype=np.float64).reshape(-1, FEATURES)


def pair_sums(x: np.ndarray, y: np.ndarray, model: dict) -> np.ndarray:
    """Slope, curvature and number of the pairs of a block, in one row: each row labelled 1 against each labelled 0."""
    z = scaled(model, x)
    better, worse = z[y == 1], z[y == 0]
    # The chance that the better one loses, for each pair.
    p = 1 / (1 + np.exp(np.clip((better @ model["w"])[:, None] - (worse @ model["w"])[None, :], -40, 40)))
    k = p * (1 - p)
    slope = worse.T @ p.sum(axis=0) - better.T @ p.sum(axis=1)
    across = better.T @ (k @ worse)
    curve = (better * k.sum(axis=1)[:, None]).T @ better + (worse * k.sum(axis=0)[:, None]).T @ worse - across - across.T
    return np.concatenate([slope, curve.ravel(), [p.size]])


def learn(model: dict, sums: Callable[[dict], np.ndarray]) -> dict:
    """``model`` with the weights that Newton's method finds for the logistic loss of the pairs, whose sums ``sums`` gives."""
    n = len(model["mean"])
    ridge, w = RIDGE[:n], np.zeros(n)
    for _ in range(ROUNDS):
        found = sums(model | {"w": w})
        slope, curve, pairs = found[:n], found[n:-1].reshape(n, n), max(found[-1], 1)
        step = np.linalg.solve(curve / pairs + np.diag(ridge), slope / pairs + ridge * w)
        w = w - step
        if np.abs(step).max() < SMALL:
            break
    return model | {"w": rounded(w)}


def rounded(x: np.ndarray) -> np.ndarray:
    """To single precision, so that the order of a sum does not show."""
    return x.astype(np.float32).astype(np.float64)


def moments(x: np.ndarray, y: np.ndarray) -> tuple:
    """(rows, rows labelled 1, means, sums of squared deviations)"""
    mean = x.mean(axis=0)
    return len(x), int((y == 1).sum()), mean, ((x - mean) ** 2).sum(axis=0)


def joined(a: tuple, b: tuple) -> tuple:
    """The moments of two sets of rows together."""
    n = a[0] + b[0]
    apart = b[2] - a[2]
    return n, a[1] + b[1], a[2] + apart * (b[0] / n), a[3] + b[3] + apart**2 * (a[0] * b[0] / n)


def unfitted(known: tuple) -> dict:
    """Scales from the moments, a weight of zero for every feature and the threshold for a missing class."""
    n, good, mean, squares = known
    spread = np.sqrt(squares / max(n, 1))
    return {"mean": rounded(mean), "spread": rounded(np.where(spread > 1e-9, spread, 1.0)), "w": np.zeros(len(mean)), "cut": float(good < n) - float(good > 0)}


def dealing(n: int, good: int, pairs: int = PAIRS) -> tuple[int, int]:
    """Number of blocks, and in how many of them each row of the rarer class stands."""
    blocks = max(1, round(n / (2 * math.sqrt(pairs))))
    return blocks, min(blocks, math.ceil(LEAST * blocks / min(good, n - good)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 5) -> dict:
    """The model of rows that are in memory; a constant score where a class is missing."""
    known = moments(x, y) if len(x) else (0, 0, np.zeros(FEATURES), np.zeros(FEATURES))
    n, good = known[:2]
    model = unfitted(known)
    if not 0 < good < n:
        return model
    blocks, copies = dealing(n, good, pairs)
    first = np.random.default_rng(seed).integers(blocks, size=n)
    times = np.where(y == (good <= n - good), copies, 1)
    inside = [np.flatnonzero((k - first) % blocks < times) for k in range(blocks)]
    model = learn(model, lambda m: sum(pair_sums(x[rows], y[rows], m) for rows in inside))
    return model | {"cut": float(np.quantile(raw_scores(model, x), (n - good) / n))}


def scaled(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["spread"], -8, 8)


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    # A sum along each row, not a product of matrices: the same whatever rows stand beside it.
    return (scaled(model, x) * model["w"]).sum(axis=1)


def score(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw_scores(model, x) - model["cut"], -40, 40)))


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id's text leaves 1 when divided by 3 (null: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.astype("<f4").tobytes() for row in x], pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").astype(np.float64).reshape(-1, FEATURES)


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of each block, over rows sorted by block."""
    last, xs, ys = None, [], []
    for batch in batches:
        block, y, x = batch["block"].to_numpy(), batch["y"].to_numpy(), unpacked(batch["x"])
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if xs and block[a] != last:
                yield np.concatenate(xs), np.concatenate(ys)
                xs, ys = [], []
            last = block[a]
            xs.append(x[a:b])
            ys.append(y[a:b])
    if xs:
        yield np.concatenate(xs), np.concatenate(ys)


def fit_rows(taught: DataFrame) -> dict:
    """The model of ``doc_id, y, x``, a row an id; the driver gets sums, a row a task."""

    def moments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            if len(batch):
                own = moments(unpacked(batch["x"]), batch["y"].to_numpy())
                known = joined(known, own) if known else own
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (known[0], known[1], known[2].tobytes(), known[3].tobytes())], names=["n", "good", "mean", "squares"])

    known = (0, 0, np.zeros(FEATURES), np.zeros(FEATURES))
    for r in taught.mapInArrow(moments_of, "n long, good long, mean binary, squares binary").collect():
        known = joined(known, (r["n"], r["good"], np.frombuffer(r["mean"]), np.frombuffer(r["squares"])))
    n, good = known[:2]
    model = unfitted(known)
    if not 0 < good < n:
        return model
    blocks, copies = dealing(n, good)
    times = F.when(F.col("y") == int(good <= n - good), copies - 1).otherwise(0)
    block = F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) + F.col("copy"), F.lit(blocks))
    dealt = taught.select("doc_id", "y", "x", F.explode(F.sequence(F.lit(0), times)).alias("copy")).select(block.alias("block"), "doc_id", "y", "x")
    # A file is one group of rows, so a block is never cut in two when it is read.
    dealt = materialize(dealt.repartition(math.ceil(blocks / TOGETHER), "block").sortWithinPartitions("block", "doc_id"), "blocks")

    def sums(model: dict) -> np.ndarray:
        def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = sum(pair_sums(x, y, model) for x, y in whole_blocks(batches))
            if not isinstance(found, int):
                yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()])], names=["sums"])

        return sum(np.frombuffer(r["sums"]) for r in dealt.mapInArrow(of_blocks, "sums binary").toLocalIterator())

    model = learn(model, sums)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw_scores(model, unpacked(batch["x"])))], names=["doc_id", "s"])

    at = (n - good) / n * (n - 1)  # the quantile, between its two neighbours
    ranks = numbered(taught.mapInArrow(rate, "doc_id long, s double"), [F.col("s"), F.col("doc_id")])
    low, high = ranks.where(F.col("_n").isin(math.floor(at), math.ceil(at))).agg(F.min("s"), F.max("s")).first()
    return model | {"cut": low + (high - low) * (at - math.floor(at))}


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    The model learns from all labelled rows that are not held out. Texts are read
    once, into their features, which are written; those meet the labels and are
    rated. Ids that are null or carry null or contradicting labels teach nothing; an id that rows of several texts carry teaches by one of them, chosen
    by its features, so that scores do not depend on partitions. A byte of the
    longest text takes about 80 bytes of a task's memory for a moment. Null text
    counts as empty; every row gets a score, repeated rows the
    same one. With no labels of one class all scores are alike. An empty table
    gives an empty result. Extra columns are ignored.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], packed(features(batch["t"]))], names=["doc_id", "x"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"))
    described = materialize(plain.mapInArrow(describe, "doc_id long, x binary"), "features")
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("y"), F.max("quality").cast("int").alias("z"))
        .where((F.col("y") == F.col("z")) & ~held_out())
        .select("doc_id", "y")
    )
    # Of rows that repeat an id the one of the least features.
    model = fit_rows(materialize(described.where(~held_out()).join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")), "taught"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score(model, unpacked(batch["x"])))], names=["doc_id", "score"])

    return described.mapInArrow(rate, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
