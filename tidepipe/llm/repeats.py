"""Removing repeated byte strings by a sparse, partitioned suffix array.

A byte goes when a string of ``WINDOW`` bytes that covers it also starts earlier
in the corpus. A suffix for every byte would be shuffled many times over, so only
anchors are: in each window the k-mer of the smallest hash. Equal windows have
the same anchor at the same place, so a window need only be compared with those
of anchors of the same k-mer.

1. Each scan task finds its anchors, with the run of windows that each anchor
   serves, and settles those whose whole surroundings came earlier in the task.
2. Anchors meet by k-mer. Those whose whole surroundings came earlier are settled;
   what has the k-mer to itself is done. The others stand where a repeat begins or
   ends, and only they need their bytes.
3. Their texts give the surroundings, which meet by k-mer again. The suffixes from
   the anchors, and the mirrored prefixes before them, are sorted deep-shallow:
   multikey sorting to a shallow depth, then a blind trie for each group that still
   agrees. The common prefixes of neighbours give, for every place of the window
   around the anchor, classes of equal windows; all but the earliest are repeats.
   A k-mer of very many surroundings is split: its windows themselves are the
   strings. A task sorts those of its documents by the same deep-shallow sort and
   sends on only the earliest of equal ones, which meet in ranges of their bytes.
4. The repeats of a document, as byte runs, meet its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_or_empty
from .textbatch import PrefixHash, mix, text_chunks

WINDOW, KMER, SHALLOW = 100, 24, 32
SPAN = WINDOW - KMER + 1
#: Anchors that a task settles among themselves at a time.
TASK_ANCHORS = 1_000_000
#: Surroundings of a k-mer beyond which it is split by its windows, and the windows that a task sorts at a time.
MANY, TASK_WINDOWS = 5000, 100_000
ROWS = "slot long, ctx long, ord long, a long"


def sliding_least(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost least value of each run of ``span`` values."""
    n = len(h) - span + 1
    place, value, width = np.arange(len(h)), h.copy(), 1
    while width < span:  # runs of width, then of twice that, then just span
        step = min(width, span - width)
        m = len(value) - step
        right = value[step:] < value[:m]
        value = np.where(right, value[step:], value[:m])
        place = np.where(right, place[step:], place[:m])
        width += step
    return place[:n]


def anchors(data: np.ndarray, hashes: PrefixHash, base: int, n: int) -> tuple[np.ndarray, ...]:
    """(k-mer, surroundings, first window, anchor - first window, windows - 1) of a text's anchors."""
    if n < WINDOW:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    at = np.arange(base, base + n - KMER + 1)
    kmers = hashes.of(at, at + KMER)
    least = sliding_least(kmers, SPAN)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    anchor = least[first]
    off = anchor - first
    surroundings = mix(hashes.of(base + first, base + last + WINDOW) + off.astype(np.uint64) * np.uint64(977) + (last - first).astype(np.uint64))
    return kmers[anchor], surroundings, first, off, last - first


def pack(first: np.ndarray, off: np.ndarray, span: np.ndarray) -> np.ndarray:
    return (first << 16) | (off << 8) | span


def unpack(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return a >> 16, (a >> 8) & 255, a & 255


def batch_of(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def run_rows(ords: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Runs travel with the anchors: a is -stop, ctx the start, and any slot will do."""
    slot = mix(ords.astype(np.uint64)).view(np.int64)
    return batch_of("slot ctx ord a", slot, start.astype(np.int64), ords.astype(np.int64), -stop.astype(np.int64))


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def settled() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        kmer, ctx, ords, a = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((a, ords, ctx, kmer))
        kmer, ctx, ords, a = kmer[order], ctx[order], ords[order], a[order]
        again = np.concatenate([[False], (kmer[1:] == kmer[:-1]) & (ctx[1:] == ctx[:-1])])
        first, _, span = unpack(a[again])
        yield batch_of("slot ctx ord a", kmer[~again].view(np.int64), ctx[~again].view(np.int64), ords[~again], a[~again])
        if again.any():
            who = ords[again]
            order = np.lexsort((first, who))
            who, start, stop = who[order], first[order], (first + span)[order] + WINDOW
            # Neighbouring anchors of a document make one run.
            new = np.concatenate([[True], (who[1:] != who[:-1]) | (start[1:] > stop[:-1])])
            at = np.flatnonzero(new)
            yield run_rows(who[at], start[at], np.maximum.reduceat(stop, at))

    for batch in batches:
        ids = batch["ord"].to_numpy()
        for row, data, offsets in text_chunks(batch["t"]):
            hashes = PrefixHash(data)
            for i in range(len(offsets) - 1):
                kmer, ctx, first, off, span = anchors(data, hashes, int(offsets[i]), int(offsets[i + 1] - offsets[i]))
                if len(kmer):
                    held.append((kmer, ctx, np.full(len(kmer), ids[row + i]), pack(first, off, span)))
        if sum(len(x[0]) for x in held) >= TASK_ANCHORS:
            yield from settled()
    yield from settled()


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by slot, ctx, ord, a: kind 1 for runs (ord, x = start, y = stop), kind 2 for anchors that need their bytes."""
    last_slot = last_ctx = None
    held: tuple[int, int, int] | None = None  # the latest first of its surroundings: slot, ord, a
    paired = False  # whether it has been handed on
    for batch in batches:
        slot, ctx, ords, a = (batch[c].to_numpy() for c in ("slot", "ctx", "ord", "a"))
        runs = a < 0
        if runs.any():
            yield batch_of("kind slot ord x y", np.full(runs.sum(), 1), slot[runs], ords[runs], ctx[runs], -a[runs])
            slot, ctx, ords, a = slot[~runs], ctx[~runs], ords[~runs], a[~runs]
        if not len(a):
            continue
        new = np.ones(len(a), dtype=bool)
        new[1:] = (slot[1:] != slot[:-1]) | (ctx[1:] != ctx[:-1])
        new[0] = slot[0] != last_slot or ctx[0] != last_ctx
        last_slot, last_ctx = slot[-1], ctx[-1]
        first, _, span = unpack(a[~new])
        if len(first):
            yield batch_of("kind slot ord x y", np.full(len(first), 1), slot[~new], ords[~new], first, first + span + WINDOW)
        if not new.any():
            continue
        s, o, f = slot[new], ords[new], a[new]
        same = np.zeros(len(s) + 1, dtype=bool)  # same[i]: firsts i - 1 and i share the k-mer
        same[1:-1] = s[1:] == s[:-1]
        same[0] = held is not None and s[0] == held[0]
        if same[0] and not paired:
            yield batch_of("kind slot ord x y", [2], [held[0]], [held[1]], [held[2]], [0])
        shared = same[:-1] | same[1:]
        if shared.any():
            yield batch_of("kind slot ord x y", np.full(shared.sum(), 2), s[shared], o[shared], f[shared], np.zeros(shared.sum(), np.int64))
        held, paired = (s[-1], o[-1], f[-1]), bool(shared[-1])


def common_prefix(a: bytes, b: bytes) -> int:
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of strings of one length, and each one's common prefix with the one before it.

    A branch is [depth, children by byte]; a leaf is the list of the equal strings.
    The first way down looks at branching bytes only; the one string reached shows
    where the new one really leaves.
    """
    size = len(strings[0])
    root: list = [-1, [0]]  # leaves are marked by depth -1
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[0] >= 0:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        e = strings[node[1][0]]
        depth = common_prefix(s, e)
        if depth == size:
            node[1].append(i)
            continue
        parent, node = None, root
        while 0 <= node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = [-1, [i]]
            continue
        branch = [depth, {e[depth]: node, s[depth]: [-1, [i]]}]
        if parent is None:
            root = branch
        else:
            parent[1][s[parent[0]]] = branch
    order: list[int] = []
    prefix: list[int] = []
    todo = [(root, 0)]
    while todo:
        node, with_before = todo.pop()
        if node[0] < 0:
            order += node[1]
            prefix += [with_before] + [size] * (len(node[1]) - 1)
        else:
            children = sorted(node[1].items())
            todo += [(c, node[0]) for _, c in children[:0:-1]] + [(children[0][1], with_before)]
    return order, prefix


def multikey_quicksort(group: np.ndarray, digits: np.ndarray) -> np.ndarray:
    """Stable order of the rows by group, then by their digits from the first to the last.

    All open segments take a step at a time: each is parted in three by the median
    of its first, middle and last digit, and what equals that goes on to the next
    digit. Segments of one row, or out of digits, are done.
    """
    order = np.argsort(group, kind="stable")
    count = np.unique(group, return_counts=True)[1]
    depth = np.zeros(len(count), dtype=np.int64)
    place = np.arange(len(group))
    while True:
        still = (count > 1) & (depth < digits.shape[1])
        place, count, depth = place[np.repeat(still, count)], count[still], depth[still]
        if not len(count):
            return order
        start = np.cumsum(count) - count
        segment = np.repeat(np.arange(len(count)), count)
        digit = digits[order[place], depth[segment]]
        x, y, z = digit[start], digit[start + count // 2], digit[start + count - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[segment]
        part = 3 * segment + (digit >= pivot) + (digit > pivot)
        order[place] = order[place[np.argsort(part, kind="stable")]]
        count = np.bincount(part, minlength=3 * len(count))
        depth = np.repeat(depth, 3)
        depth[1::3] += 1


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of (group, string) and common prefixes of neighbours, -1 between groups.

    ``strings`` is an array of bytes, a row each. Digits of eight bytes are sorted by
    multikey quicksort to the depth SHALLOW; rows that are equal so far, and whole
    groups of them, go through a blind trie.
    """
    n = len(strings)
    digits = np.ascontiguousarray(strings[:, :SHALLOW]).view(">u8").astype(np.uint64)
    order = multikey_quicksort(group, digits)
    prefix = np.full(n, -1)
    if n > 1:
        x, y = order[1:], order[:-1]
        differ = strings[x, :SHALLOW] != strings[y, :SHALLOW]
        prefix[1:] = np.where(group[x] != group[y], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), SHALLOW))
    starts = np.flatnonzero(prefix < SHALLOW)
    stops = np.append(starts[1:], n)
    for b, e in zip(starts[stops - starts > 1], stops[stops - starts > 1], strict=True):
        rows = order[b:e]
        deep, shared = blind_trie([r.tobytes() for r in strings[rows]])
        order[b:e] = rows[deep]
        prefix[b + 1 : e] = shared[1:]
    return order, prefix


def settle(slot: np.ndarray, ords: np.ndarray, a: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, window start) of the repeated windows of whole k-mer groups.

    Windows with the anchor at the same place o are equal if the surroundings
    agree for o bytes before the anchor and WINDOW - o bytes from it on.
    """
    rank = np.lexsort((a, ords, slot))
    slot, ords, a, bodies = slot[rank], ords[rank], a[rank], [bodies[i] for i in rank]
    first, off, span = unpack(a)
    right, left = np.zeros((len(a), WINDOW + 4), np.uint8), np.zeros((len(a), SPAN + 3), np.uint8)
    for i, body in enumerate(bodies):
        b = np.frombuffer(body, np.uint8)
        right[i, : len(b) - off[i]] = b[off[i] :]
        left[i, : off[i]] = b[: off[i]][::-1]
    n = len(a)

    def classes(order: np.ndarray, prefix: np.ndarray, depth: int) -> np.ndarray:
        out = np.empty(n, dtype=np.int64)
        out[order] = np.cumsum(prefix < depth)
        return out

    forward, backward = deep_shallow(slot, right), deep_shallow(slot, left)
    rows, starts = [], []
    for o in range(SPAN):
        there = np.flatnonzero((off - span <= o) & (o <= off))
        if len(there) < 2:
            continue
        key = classes(*forward, WINDOW - o)[there] * (n + 1) + classes(*backward, o)[there]
        _, earliest = np.unique(key, return_index=True)  # rows are in order of (ord, start)
        again = np.ones(len(there), dtype=bool)
        again[earliest] = False
        again = there[again]
        rows.append(again)
        starts.append((first + off)[again] - o)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return ords[np.concatenate(rows)], np.concatenate(starts)


def as_runs(ords: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((starts, ords))
    ords, starts = ords[order], starts[order]
    new = np.ones(len(ords), dtype=bool)
    new[1:] = (ords[1:] != ords[:-1]) | (starts[1:] > starts[:-1] + WINDOW)
    at = np.flatnonzero(new)
    stops = np.maximum.reduceat(starts, at) + WINDOW if len(at) else starts
    return batch_of("ord start stop", ords[at], starts[at], stops)


def settle_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by slot: some groups at a time."""
    held: list[tuple] = []

    def done(upto: int | None) -> Iterator[pa.RecordBatch]:
        slot, ords, a = (np.concatenate([h[i] for h in held]) for i in range(3))
        bodies = [b for h in held for b in h[3]]
        cut = len(slot) if upto is None else int(np.searchsorted(slot, upto))
        held.clear()
        if cut < len(slot):
            held.append((slot[cut:], ords[cut:], a[cut:], bodies[cut:]))
        if cut:
            yield as_runs(*settle(slot[:cut], ords[:cut], a[:cut], bodies[:cut]))

    for batch in batches:
        if len(batch):
            held.append((batch["slot"].to_numpy(), batch["ord"].to_numpy(), batch["a"].to_numpy(), batch["body"].to_pylist()))
            if sum(len(h[0]) for h in held) >= 2 * MANY:
                yield from done(held[-1][0][-1])
    if held:
        yield from done(None)


def bodies_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The surroundings of each anchor that a document lists."""
    for batch in batches:
        for ord_, text, wanted in zip(batch["ord"].to_pylist(), batch["t"], batch["wanted"].to_pylist(), strict=True):
            data = text.as_py().encode()
            slot, a, body, split = [], [], [], []
            for w in wanted:
                first, span = w["a"] >> 16, w["a"] & 255
                slot.append(w["slot"])
                a.append(w["a"])
                body.append(data[first : first + span + WINDOW])
                split.append(w["split"])
            yield batch_of("slot ord a body split", pa.array(slot, pa.int64()), pa.array([ord_] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(body, pa.binary()), pa.array(split, pa.bool_()))


def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the equal windows in a task's rows the earliest, and runs of the others (window null)."""
    held: list[tuple[int, int, bytes]] = []

    def settled() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        held.sort(key=lambda row: row[:2])
        views = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(body, np.uint8), WINDOW) for _, _, body in held]
        ords = np.repeat([ord_ for ord_, _, _ in held], [len(v) for v in views])
        starts = np.concatenate([np.arange(len(v)) + (a >> 16) for (_, a, _), v in zip(held, views, strict=True)])
        held.clear()
        strings = np.concatenate(views)
        order, prefix = deep_shallow(np.zeros(len(strings), np.int64), strings)  # stable: the earliest of equal ones comes first
        again = order[prefix == WINDOW]
        runs = as_runs(ords[again], starts[again])
        yield batch_of("window ord start stop", pa.nulls(len(runs), pa.binary()), *runs.columns)
        first = order[prefix < WINDOW]
        whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WINDOW), len(first), [None, pa.py_buffer(strings[first].tobytes())])
        yield batch_of("window ord start stop", whole.cast(pa.binary()), ords[first], starts[first], starts[first] + WINDOW)

    n = 0
    for batch in batches:
        for row in zip(batch["ord"].to_pylist(), batch["a"].to_pylist(), batch["body"].to_pylist(), strict=True):
            held.append(row)
            n += (row[1] & 255) + 1
            if n >= TASK_WINDOWS:
                yield from settled()
                n = 0
    yield from settled()


def again_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by window, ord, start: runs of all windows that equal the one before."""
    last = None
    for batch in batches:
        if len(batch):
            window = batch["window"]
            same = np.zeros(len(batch), dtype=bool)
            same[0] = window[0].as_py() == last
            same[1:] = pc.equal(window[1:], window[:-1]).to_numpy(zero_copy_only=False)
            last = window[-1].as_py()
            yield as_runs(batch["ord"].to_numpy()[same], batch["start"].to_numpy()[same])


def strip_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, runs in zip(batch["t"], batch["runs"].to_pylist(), strict=True):
            data, keep, end, spans, removed = text.as_py().encode(), [], 0, 0, 0
            for start, stop in sorted((r["start"], r["stop"]) for r in runs or []):
                if start > end or not spans:
                    keep.append(data[end:start])
                    spans += 1
                    removed += stop - start
                    end = stop
                elif stop > end:
                    removed += stop - end
                    end = stop
            keep.append(data[end:])
            for column, value in zip(out, (len(data), removed, spans, hashlib.sha256(b"".join(keep)).hexdigest()), strict=True):
                column.append(value)
        kinds = (pa.int64(),) * 3 + (pa.string(),)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Null text counts as empty; texts under ``WINDOW`` bytes lose nothing. Where ids
    are null or repeat, rows are put in order by (id, null last, text) and each is
    a document of its own. An empty table gives an empty result. Extra columns are
    ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"))
    ids = plain.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.countDistinct("doc_id").alias("distinct")).first()
    if ids["n"] == ids["distinct"]:
        plain = plain.withColumn("ord", F.col("doc_id"))
    else:
        plain = materialize(plain.orderBy(F.col("doc_id").isNull(), "doc_id", "t").withColumn("ord", F.monotonically_increasing_id()), "ordered")
    parts = shuffle_partitions(docs.sparkSession)
    texts = plain.select("ord", "t")

    met = materialize(
        texts.mapInArrow(find_anchors, ROWS)
        .repartition(parts, "slot")
        .sortWithinPartitions("slot", "ctx", "ord", "a")
        .mapInArrow(meet, "kind long, slot long, ord long, x long, y long"),
        "met",
    )
    open_ = met.where("kind = 2").select("slot", "ord", F.col("x").alias("a"))
    sizes = open_.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))

    runs = met.where("kind = 1").select("ord", F.col("x").alias("start"), F.col("y").alias("stop"))
    many = materialize(sizes.where(F.col("n") > MANY).select("slot", F.lit(True).alias("split")), "many")
    split = bool(many.take(1))
    wanted = (open_.join(many, "slot", "left") if split else open_.withColumn("split", F.lit(None).cast("boolean"))).select("ord", F.struct("slot", "a", F.coalesce("split", F.lit(False)).alias("split")).alias("w"))
    bodies = texts.join(wanted.groupBy("ord").agg(F.collect_list("w").alias("wanted")), "ord").mapInArrow(bodies_of, "slot long, ord long, a long, body binary, split boolean")
    if split:
        bodies = materialize(bodies, "bodies")  # the texts travel once for both ways
        windows = materialize(bodies.where("split").mapInArrow(windows_of, "window binary, ord long, start long, stop long"), "windows")
        firsts = windows.where("window is not null").select("window", "ord", "start")
        again = firsts.repartition(parts, "window").sortWithinPartitions("window", "ord", "start").mapInArrow(again_windows, "ord long, start long, stop long")
        runs = runs.union(windows.where("window is null").drop("window")).union(again)
        bodies = bodies.where("not split")
    settled = bodies.drop("split").repartition(parts, "slot").sortWithinPartitions("slot").mapInArrow(settle_groups, "ord long, start long, stop long")
    runs = materialize(runs.union(settled), "runs").groupBy("ord").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    return plain.join(runs, "ord", "left").select("doc_id", "t", "runs").mapInArrow(strip_runs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
