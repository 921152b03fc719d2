"""Near-duplicates by Order MinHash and banded alignment.

Texts are sequences of five-word shingles, each labelled with its occurrence in
the text, so that a text is a sequence of distinct items. Two texts are linked
when their longest common subsequence of items, m of n and n', gives
m / (n + n' - m) of 0.8 or more: the Jaccard similarity that also asks for the
same order.

Order MinHash: for each of 16 seeds the three items of the smallest seeded
hashes are taken and put back in text order; the hash of that triple is the
text's sketch. Texts of similarity s share a sketch with a chance of about s^3,
so at 0.8 all 16 fail to meet once in 100,000. Equal texts are one node from the
start; the links of nodes are checked by an alignment whose band is as wide as
0.8 allows, so the band loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, WHITE_RUN, content_key, dropped, materialize, one_of_alike, shuffle_partitions, text_or_empty
from .textbatch import MIX_A, PrefixHash, mix, powers, text_chunks, words

SHINGLE_WORDS, SKETCHES, TAKEN, SIMILARITY = 5, 16, 3, 0.8
#: Members of a bucket that one side of a tile holds on average, and items that it multiplies at a time.
BLOCK, COLUMNS = 256, 4096
SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))
PLACE = powers(0xD6E8FEB86659FD93, max(SHINGLE_WORDS, TAKEN) + 1)


def items_of(word_hashes: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The occurrence-labelled shingles of a text, in order; a text of fewer words is one shingle."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    k = min(k, n)
    shingles = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        shingles += word_hashes[j : n - k + 1 + j] * PLACE[j + 1]
    shingles = mix(shingles)
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return shingles
    at = np.arange(len(ranked))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(shingles)
    out[order] = mix(ranked + nth.astype(np.uint64) * MIX_A)
    return out


def order_minhash(items: np.ndarray) -> np.ndarray:
    """The sketches of a text's items, empty for none."""
    if not len(items):
        return np.zeros(0, dtype=np.uint64)
    seeded = mix(items[None, :] ^ SEEDS[:, None])
    k = min(TAKEN, len(items))
    least = np.argpartition(seeded, k - 1, axis=1)[:, :k]
    least.sort(axis=1)
    return mix((items[least] * PLACE[1 : k + 1]).sum(axis=1, dtype=np.uint64) ^ SEEDS)


def common_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences of distinct items, within the band of 0.8.

    Items that m pairs of a common subsequence align lie at most
    max(n, n') - m places apart, and m is at least 0.8 / 1.8 of n + n' or there is
    no link. Distinct items make the subsequence the longest rising run of the
    places in b, taken in the order of a.
    """
    needed = int(np.ceil(SIMILARITY / (1 + SIMILARITY) * (len(a) + len(b)) - 1e-9))
    band = max(len(a), len(b)) - needed
    if band < 0 or min(len(a), len(b)) < needed:
        return 0
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(in_a - in_b) <= band
    in_a, in_b = in_a[near], in_b[near]
    if len(in_a) < needed:
        return 0
    places = in_b[np.argsort(in_a)]
    if (np.diff(places) > 0).all():
        return len(places)
    from bisect import bisect_left

    ends: list[int] = []
    for p in places.tolist():
        i = bisect_left(ends, p)
        ends[i : i + 1] = [p]
    return len(ends)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    m = common_in_order(a, b)
    return m / (len(a) + len(b) - m)


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text in turn."""
    for _, data, offsets in text_chunks(texts):
        start, stop, first = words(data, offsets)
        hashes = PrefixHash(data).of(start, stop)
        for i in range(len(offsets) - 1):
            yield hashes[first[i] : first[i + 1]]


def sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, sketches = [], []
        for hashes in word_hashes(batch["t"]):
            items = items_of(hashes)
            sizes.append(len(items))
            sketches.append(order_minhash(items).view(np.int64))
        columns = [batch["doc_id"], batch["row"], batch["digest"], pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "digest", "n", "sketch"])


def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes instead of texts, four bytes a word: enough to align by."""
    for batch in batches:
        packed = [(h >> np.uint64(32)).astype("<u4").tobytes() for h in word_hashes(batch["t"])]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(packed, pa.binary())], names=["node", "words"])


def unpack_items(packed: pa.BinaryScalar) -> np.ndarray:
    return items_of(mix(np.frombuffer(packed.as_buffer(), dtype="<u4").astype(np.uint64) + np.uint64(1)))


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked, last, items = [], None, None
        for a, wa, wb in zip(batch["a"].to_pylist(), batch["wa"], batch["wb"], strict=True):
            if a != last:
                last, items = a, unpack_items(wa)
            linked.append(similarity(items, unpack_items(wb)) >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def overlaps(items: list[np.ndarray]) -> np.ndarray:
    """How many items each two sequences share, by products of blocks of an incidence matrix."""
    m = len(items)
    at = np.repeat(np.arange(m), [len(x) for x in items])
    values = np.concatenate(items) if m else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, at = values[order], at[order]
    column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]])) if len(values) else values.astype(np.int64)
    out = np.zeros((m, m), dtype=np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + COLUMNS])
        part = np.zeros((m, COLUMNS), dtype=np.float32)
        part[at[lo:hi], column[lo:hi] - c] = 1
        out += part @ part.T
    return out


def links_in_tile(nodes: list[int], roots: list[int], blocks: list[int], items: list[np.ndarray], across: bool) -> list[tuple[int, int]]:
    """Links between different components, as few as join what is linked; ``across``: between the two blocks only.

    Shared items bound a common subsequence from above, so only pairs that share
    enough are aligned, those that share most first.
    """
    above = {r: r for r in roots}

    def find(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    size = np.array([len(x) for x in items])
    share = overlaps(items)
    both = size[:, None] + size[None, :]
    ratio = share / np.maximum(both - share, 1)
    ratio[both == 0] = 1
    _, root = np.unique(np.array(roots), return_inverse=True)
    could = np.triu(ratio >= SIMILARITY - 1e-6, 1) & (root[:, None] != root[None, :])
    if across:
        block = np.array(blocks)
        could &= block[:, None] != block[None, :]
    i, j = np.nonzero(could)
    found = []
    for k in np.argsort(-ratio[i, j], kind="stable"):
        a, b = int(i[k]), int(j[k])
        x, y = find(roots[a]), find(roots[b])
        if x != y and similarity(items[a], items[b]) >= SIMILARITY:
            above[max(x, y)] = min(x, y)
            found.append((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
    return found


def compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by tile, a tile at a time; a tile holds two blocks at most."""
    key, rows = None, []

    def done() -> pa.RecordBatch:
        found = links_in_tile([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], key[1] != key[2]) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("bucket", "x", "y", "node", "root", "block")]
        for bucket, x, y, node, root, block, packed in zip(*columns, batch["words"], strict=True):
            if key != (bucket, x, y):
                if rows:
                    yield done()
                key, rows = (bucket, x, y), []
            rows.append((node, root, block, unpack_items(packed)))
    if rows:
        yield done()


def components(links: DataFrame, nodes_col: tuple[str, str] = ("a", "b")) -> DataFrame:
    """``node, root`` for every node of a link, root the smallest node of its component.

    Every round each node takes the smallest root among its neighbours' and then
    its root's root, until a round changes nothing. Links of hot nodes are
    combined before they are shuffled. Roots are written each round, so lineage
    stays short, and those of the round before are removed.
    """
    a, b = nodes_col
    both = materialize(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(b, a)).distinct(), "links")
    roots = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")).withColumnRenamed("x", "node"), "roots")
    while True:
        seen = both.join(roots.select(F.col("node").alias("y"), "root"), "y").select(F.col("x").alias("node"), "root")
        least = seen.union(roots).groupBy("node").agg(F.min("root").alias("root"))
        jumped = least.alias("l").join(least.select(F.col("node").alias("root"), F.col("root").alias("above")), "root").select("node", F.least("root", "above").alias("root"))
        old = roots.withColumnRenamed("root", "old")
        new = materialize(jumped.join(old, "node"), "roots")
        dropped(roots)
        roots = new.select("node", "root")
        if not new.where("root < old").take(1):
            dropped(both)
            return roots


def spaced(text_col: str = "text") -> Column:
    """The words of a text, a space between them."""
    return F.trim(F.regexp_replace(text_or_empty(text_col), WHITE_RUN, " "))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size, kept``.

    A class is a component of the links; its id is its smallest doc_id, and the
    row that carries it is the one kept.

    Texts of the same words are one node, whatever their white space. Nodes that
    share a sketch form a bucket. A bucket never becomes pairs: its most central
    node (the one whose buckets are the fullest, which is where copies of one
    original meet) leads it and every member is aligned with the leader. Buckets
    whose members that leaves in several components are compared whole, component
    against component, by tiles of bounded blocks: a product of incidence matrices says which pairs share enough
    items to be linked, and only links between different components leave a tile.

    Null text counts as empty; empty texts are one class. Texts of under five
    words are linked only if their words are equal. A null id sorts last in its
    class. Of rows that repeat an id one is kept. Extra columns are ignored. An
    empty table gives an empty result.
    """
    return classes_of(docs, text_col, id_col).select("doc_id", "class_id", "class_size", "kept")


def classes_of(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """:func:`near_duplicates` with each row's digest."""
    shaped = docs.select(F.col(id_col).cast("long").alias("doc_id"), spaced(text_col).alias("t")).withColumn("digest", F.unhex(F.sha2("t", 256)))
    sketched = materialize(shaped.withColumn("row", F.monotonically_increasing_id()).mapInArrow(sketch_rows, "doc_id long, row long, digest binary, n long, sketch array<long>"), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    nodes = materialize(
        sketched.groupBy("digest").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    links = materialize(find_links(shaped, nodes), "found")
    roots = components(links)
    placed = nodes.select("node", "digest", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.groupBy("root").agg(F.min("least").alias("first"), F.sum("copies").alias("class_size"))
    by_text = placed.join(classes, "root").select("digest", "first", "class_size")
    return sketched.select("doc_id", "row", "digest").join(by_text, "digest").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "digest",
    )


def find_links(shaped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) of nodes, a < b, that join all nodes of a class.

    First every member of a bucket is aligned with the bucket's leader. A bucket
    whose members are then in one component, or that has only the two, is done. In
    the others the members are compared by tiles, of which only links between
    different components come out; see :func:`tiles_of`.
    """
    rows = nodes.select("node", F.explode("sketch").alias("bucket"))
    # Counts and leaders are written before rows meet them: a join of two plain
    # shuffles is one that AQE can split where a bucket is hot.
    full = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "full")
    members = rows.join(full, "bucket")
    central = members.groupBy("node").agg(F.sum("members").alias("central"))
    members = materialize(members.join(central, "node"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "digest", content_key(F.col("least.doc_id")).alias("id")), "node")
    # Rows that repeat an id and a text are one here.
    texts = shaped.select("digest", content_key(F.col("doc_id")).alias("id"), "t").join(wanted, ["digest", "id"]).dropDuplicates(["digest", "id"]).select("node", "t")
    texts = materialize(texts.mapInArrow(pack_words, "node long, words binary"), "words")

    best = F.max(F.struct("central", (-F.col("node")).alias("minus"))).alias("best")
    lead = materialize(members.groupBy("bucket").agg(best).select("bucket", (-F.col("best.minus")).alias("a")), "lead")
    pairs = lead.join(members.select("bucket", F.col("node").alias("b")), "bucket").where("a != b").select("a", "b").distinct()
    sides = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "ab"]
    sized = pairs.join(sides[0], "a").join(sides[1], "b").where(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - 1e-9)
    both = sized.select("a", "b").join(texts.toDF("b", "wb"), "b").join(texts.toDF("a", "wa"), "a")
    led = materialize(both.mapInArrow(verify, "a long, b long, linked boolean").where("linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "led")
    roots = components(led)

    # Buckets that still hold several components; of buckets with the same members, one.
    placed = members.where("members > 2").select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who"), F.min("node").alias("first"))
    mixed = materialize(mixed.where("low != high").groupBy("members", "who", "first").agg(F.min("bucket").alias("bucket")), "mixed")
    tiles = tiles_of(placed.join(mixed.select("bucket"), "bucket").join(nodes.select("node", "n"), "node"))
    tiles = tiles.join(texts, "node").repartition(shuffle_partitions(shaped.sparkSession), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "node")
    more = tiles.mapInArrow(compare_tiles, "a long, b long")
    return led.union(more).distinct()


def tiles_of(placed: DataFrame) -> DataFrame:
    """``bucket, x, y, block, node, root``: the members (bucket, node, root, n) of buckets in the tiles of two blocks that may hold links between components.

    Texts of similarity 0.8 differ in their number of items by a quarter at most,
    so blocks lie in bands of size and meet those of their own and the next band. A
    component of many members in a band has blocks of its own, and two blocks of one
    component never meet: where one component fills a bucket, the others meet it
    in a number of tiles that grows with the bucket, not with its square.
    """
    banded = placed.withColumn("band", F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / float(np.log(1.01 / SIMILARITY))).cast("int"))
    per_root = banded.groupBy("bucket", "band", "root").agg(F.count(F.lit(1)).alias("c"))
    per_root = materialize(per_root.withColumn("whose", F.when(F.col("c") > BLOCK // 2, F.col("root")).otherwise(F.lit(-1))), "per_root")
    parts = per_root.groupBy("bucket", "band", "whose").agg(F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"))
    along = Window.partitionBy("bucket").orderBy("band", "whose").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("first", F.coalesce(F.sum("blocks").over(along), F.lit(0)).cast("int")), "parts")
    near = parts.select("bucket", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), F.col("whose").alias("whose_other"), F.col("first").alias("first_other"), F.col("blocks").alias("blocks_other"))
    meet = parts.join(near, ["bucket", "band"]).where((F.col("whose") != F.col("whose_other")) | (F.col("whose") == -1))
    others = meet.select("bucket", "band", "whose", "first", "blocks", F.explode(F.sequence(F.col("first_other"), F.col("first_other") + F.col("blocks_other") - 1)).alias("other"))
    split = banded.join(per_root.select("bucket", "band", "root", "whose"), ["bucket", "band", "root"]).join(others, ["bucket", "band", "whose"])
    block = F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return split.withColumn("block", block).select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "root")


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class of near copies: same columns.

    Rows are found again by their id and digest. Edge cases as in :func:`near_duplicates`.
    """
    kept = classes_of(docs, text_col, id_col).where("kept").select(content_key(F.col("doc_id"), F.hex("digest")).alias(KEY))
    keyed = docs.withColumn(KEY, content_key(F.col(id_col), F.upper(F.sha2(spaced(text_col), 256))))
    return one_of_alike(keyed.join(materialize(kept, "kept"), KEY, "left_semi"), KEY)
