"""Packing token sequences: a configuration linear program over the length histogram.

Documents become pieces of at most ``capacity`` tokens, and pieces are counted
by length. A configuration is a multiset of lengths that fits one sequence. The
linear program covers every length's count by configurations at the least
number of sequences; multiplicative weights give its prices and an unbounded
knapsack over the lengths gives the configurations of nearly the best price. The
histogram has at most ``capacity`` bars however many documents there are, so
this part is a small fixed piece of work on the driver. Configurations are used
whole times; what they leave goes by best fit. Where lengths are so
uneven that the rounds end without a cover, that can be most pieces.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_or_empty

#: Words whose ids a worker remembers; twice as many are held at most.
WORDS_KEPT = 300_000
#: Texts are tokenized together up to so many characters.
TOGETHER = 1 << 19
#: Where the shortcut does not begin: at the separators at which only ``str.split``
#: cuts, and at what could be a special token.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: The tokenizer parts a letter from the punctuation after it; apostrophes aside.
LETTERS, MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", "!-&(-/:-@\\[-`{-~"
SEAM = re.compile(f"(?<=[{LETTERS}])(?=[{MARKS}])")
#: Words that are one unit to the tokenizer, so that one token of theirs ends it.
UNIT = re.compile(f"[{LETTERS}]+|[{MARKS}]+")
WORD_END = "</w>"
#: How far a configuration's price may be below the best; the share of pieces that ends the rounds; the first step of the weights.
NEAR, REST, STEP = (0.002, 0.01), 0.02, 0.4

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of whole texts, word by word, as little-endian bytes.

    The tokenizer lowers case, drops white space, never looks across it and never
    joins a letter and the punctuation after it, so a text's ids are those of its
    parts. Parts are remembered; new ones are encoded many at a time. Texts with
    odd characters are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith(WORD_END)
        self.ends = ends
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def learn(self, words: set[str]) -> None:
        """Puts the ids of all ``words`` into ``known``."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > WORDS_KEPT:
            self.older, self.known = self.known, {}
            new = words
        if self.older:  # walk the new words, not the many remembered ones
            self.known |= {w: self.older[w] for w in new if w in self.older}
        new = list(new.difference(self.known))
        units = [w for w in new if UNIT.fullmatch(w)]
        if units:
            ids = self.encode([" ".join(units)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(units):
                raise AssertionError("the tokenizer does not end words as described")
            data, begin = ids.tobytes(), 0
            for w, stop in zip(units, (stops * 4).tolist(), strict=True):
                self.known[w] = data[begin:stop]
                begin = stop
        rest = [w for w in new if w not in self.known]
        for w, ids in zip(rest, self.encode(rest) if rest else [], strict=True):
            self.known[w] = ids.tobytes()

    @staticmethod
    def parts(text: str) -> list[str] | None:
        """The text's units, or none if it has characters beyond Latin-1 or odd ones."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if any(x in text for x in ODD) else SEAM.sub(" ", text.lower()).split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [self.parts(t) for t in texts]
        self.learn(set().union(*[p for p in parts if p]))
        ids_of = self.known.__getitem__
        return [self.encode([t])[0].tobytes() if p is None else b"".join(map(ids_of, p)) for t, p in zip(texts, parts, strict=True)]


def groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about TOGETHER characters."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1])
        if size >= TOGETHER:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Rows of PIECES for (doc_id, row, t)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            docs_, rows = batch["doc_id"].to_pylist(), batch["row"].to_pylist()
            for first, texts in groups(batch["t"]):
                for i, ids in enumerate(ids_of(texts), first):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (docs_[i], rows[i], k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, PIECES)


def best_values(prices: np.ndarray, capacity: int) -> np.ndarray:
    """The highest price that fits into every room from 0 to ``capacity``: an unbounded knapsack.

    ``prices`` has one entry a length from 0 on, minus infinity where there is none.
    """
    best = np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        best[room] = max(best[room - 1], (prices[1 : room + 1] + best[room - 1 :: -1]).max())
    return best


def configuration(prices: np.ndarray, best: np.ndarray, left: np.ndarray, floor: float) -> dict[int, int]:
    """A configuration of at least the price ``floor`` out of the pieces ``left``, longest first; empty if none is found."""
    room, price, found = len(best) - 1, 0.0, {}
    left = left.copy()
    while True:
        have = np.flatnonzero(left[: room + 1])
        good = have[price + prices[have] + best[room - have] >= floor]
        if not len(good):
            return found if price >= floor else {}
        n = int(good[-1])
        found[n] = found.get(n, 0) + 1
        left[n] -= 1
        room -= n
        price += prices[n]


def best_configuration(prices: np.ndarray, lengths: list[int], capacity: int) -> dict[int, int]:
    """The multiset of lengths of the highest price that fits."""
    by_length = np.full(capacity + 1, -np.inf)
    by_length[lengths] = prices
    left = np.zeros(capacity + 1, dtype=np.int64)
    left[lengths] = capacity // np.array(lengths)
    best = best_values(by_length, capacity)
    return configuration(by_length, best, left, best[capacity] * (1 - 1e-9))


def cover(prices: np.ndarray, need: np.ndarray) -> tuple[dict[tuple, int], np.ndarray, float]:
    """Configurations of nearly the best price and their times, the pieces they leave, and the best price.

    Of one knapsack many configurations are read off: the next is made of the
    pieces still left, and the knapsack is solved again over those only when its
    table finds none. The tolerances of NEAR are used one after the other.
    """
    capacity = len(need) - 1
    left, used = need.copy(), {}
    best = best_values(prices, capacity)
    most, fresh = best[capacity], True
    for near in NEAR:
        while left.any():
            config = configuration(prices, best, left, most * (1 - near))
            if config:
                times = min(int(left[n]) // k for n, k in config.items())
                key = tuple(sorted(config.items(), reverse=True))
                used[key] = used.get(key, 0) + times
                for n, k in config.items():
                    left[n] -= k * times
                fresh = False
            elif fresh:
                break
            else:
                best, fresh = best_values(np.where(left > 0, prices, -np.inf), capacity), True
    return used, left, float(most)


def best_fit(left: dict[int, int], capacity: int) -> dict[tuple, int]:
    """The longest piece left, then always the longest that still fits, as often as the counts left allow."""
    left, used = {n: c for n, c in left.items() if c > 0}, {}
    while left:
        have, room, config = sorted(left), capacity, {}
        while have and (i := bisect.bisect_right(have, room)):
            n = have[i - 1]
            config[n] = min(room // n, left[n])
            room -= n * config[n]
            del have[i - 1 :]
        times = min(left[n] // k for n, k in config.items())
        key = tuple(sorted(config.items(), reverse=True))
        used[key] = used.get(key, 0) + times
        for n, k in config.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return used


def solve(counts: dict[int, int], capacity: int, rounds: int = 24) -> tuple[dict[tuple, int], dict[tuple, int], int]:
    """Times of the linear program's configurations, those of best fit for the rest, and a lower bound of the sequences.

    Multiplicative weights: a length's price falls with the share of its count that
    a round's configurations cover, by ever smaller steps. A round covers what it can
    by whole times of configurations whose price is the best up to NEAR, so there is
    nothing to round down; a cover of all pieces at the best price would be optimal.
    All counts at their prices over the best price are a lower bound. Rounds
    end when a cover leaves at most REST of the pieces or a plan meets the bound. The
    plan of the fewest sequences is used, and best fit alone is one of the plans.
    """
    need = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        need[n] = c
    lengths = np.flatnonzero(need)
    plan: tuple[dict[tuple, int], dict[tuple, int]] = ({}, best_fit(counts, capacity))
    total, fewest, bound = int(need.sum()), sum(plan[1].values()), 0
    log_weights = np.zeros(len(lengths))
    for i in range(rounds if total else 0):
        prices = np.full(capacity + 1, -np.inf)
        # A piece of twice the length is worth twice as much at even coverage.
        prices[lengths] = lengths * np.exp(log_weights - log_weights.max())
        used, left, most = cover(prices, need)
        bound = max(bound, math.ceil(float((need[lengths] * prices[lengths]).sum()) / most - 1e-6))
        rest = best_fit({int(n): int(left[n]) for n in np.flatnonzero(left)}, capacity)
        sequences = sum(used.values()) + sum(rest.values())
        if sequences < fewest or (sequences == fewest and sum(used.values()) > sum(plan[0].values())):
            plan, fewest = (used, rest), sequences
        if fewest <= bound or left.sum() <= REST * total:
            break
        log_weights -= STEP / (1 + i) ** 0.7 * (need - left)[lengths] / need[lengths]
    return *plan, bound


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, configuration) pairs that hold exactly ``counts`` pieces of each length."""
    used, rest, _ = solve(counts, capacity)
    for key, times in rest.items():
        used[key] = used.get(key, 0) + times
    return [(times, dict(key)) for key, times in sorted(used.items(), reverse=True)]


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces and their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    The k-th piece of a length goes to the k-th free place of that length; ranks
    are counted within fixed salts of a length and shifted by the salts' counts,
    so a length that a third of the pieces share is not one task. The places are a
    broadcast table of at most a few thousand rows: it grows with ``capacity``,
    never with the documents.

    A null or empty text is one piece: the end id alone. Rows that repeat an id
    are documents of their own; a null id is kept. An empty table gives an empty
    result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty().alias("t"))
    cut = materialize(pieces(rows, tokenizer, capacity, end_id), "pieces")
    salts = 4 * shuffle_partitions(spark)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)))
    by_salt = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    places, first = [], 0
    rank_from: dict[int, int] = {}
    for times, config in plan_sequences(counts, capacity):
        offset = 0
        for length, k in sorted(config.items(), reverse=True):
            places.append((length, rank_from.get(length, 0), rank_from.get(length, 0) + times * k, first, k, offset))
            rank_from[length] = rank_from.get(length, 0) + times * k
            offset += length * k
        first += times
    place = spark.createDataFrame(places, "length long, rank_from long, rank_to long, first long, each long, at long")

    shift = by_salt.withColumn("shift", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        cut.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1)
        .join(shift.select("length", "salt", F.coalesce("shift", F.lit(0)).alias("shift")), ["length", "salt"])
        .withColumn("rank", F.col("r") + F.col("shift"))
    )
    nth = F.col("rank") - F.col("rank_from")
    return (
        ranked.alias("x")
        .join(F.broadcast(place.alias("p")), (F.col("x.length") == F.col("p.length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select(
            "doc_id",
            "piece",
            "start",
            F.col("x.length").alias("length"),
            "ids_crc32",
            (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + F.pmod(nth, F.col("each")) * F.col("x.length")).cast("long").alias("offset"),
        )
    )
