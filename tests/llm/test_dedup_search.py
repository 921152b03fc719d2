"""Repeats, near-duplicates and nearest neighbours against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepipe.llm import near_dedup as N
from tidepipe.llm import repeats as R
from tidepipe.llm.nearest import nearest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}x{i * 7 % 31}" for i in range(400)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- repeats --------------------------------------------------------------------


def brute_repeats(rows, window=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if b[s : s + window] in seen:
                cover[s : s + window] = b"\1" * window
            seen.add(b[s : s + window])
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((i, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats(seed):
    rng = random.Random(seed)
    passages = [prose(rng, 30) for _ in range(4)]
    rows = []
    for i in range(60):
        t = prose(rng, rng.randrange(0, 60)) + rng.choice(passages) + " é " + prose(rng, rng.randrange(0, 40))
        if i % 4 == 0:
            t += rng.choice(passages)[rng.randrange(30) :]
        if rows and i % 5 == 0:
            t = (rows[rng.randrange(len(rows))][1] or "")[: rng.randrange(50, 500)] + "|" + t
        rows.append((i * 3, t))
    return [*rows, (1, None), (4, ""), (7, "a" * 350), (10, "ab" * 200), (13, rows[5][1]), (16, "x" * 99)]


@pytest.mark.parametrize("many", [5000, 3])
def test_repeats_against_brute_force(spark, many, monkeypatch):
    monkeypatch.setattr(R, "MANY", many)  # 3: the way of very common passages
    rows = texts_with_repeats(5)
    df = docs(spark, rows).withColumn("ord", F.lit("clash")).repartition(5)
    assert sorted(map(tuple, R.remove_repeats(df).collect())) == sorted(brute_repeats(rows))


def test_texts_meet_their_anchors_once(spark, monkeypatch):
    monkeypatch.setattr(R, "MANY", 3)
    df = spark.createDataFrame(texts_with_repeats(5)[:40], "doc_id long, text string")
    calls, original = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a: calls.append(f) or original(self, f, *a))
    R.remove_repeats(df)
    assert R.windows_of in calls and calls.count(R.bodies_of) == 1


def test_repeats_of_repeated_and_null_ids(spark):
    rows = [*texts_with_repeats(6)[:20], (3, "y" * 150), (3, "y" * 150), (None, "y" * 150), (None, None)]
    key = lambda r: repr(tuple(r))
    assert sorted(R.remove_repeats(docs(spark, rows)).collect(), key=key) == [tuple(x) for x in sorted(brute_repeats(rows), key=key)]
    assert R.remove_repeats(docs(spark, [])).collect() == []


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 500):
        group, digits = rng.integers(0, 4, n), rng.integers(0, 3, (n, 4)).astype(np.uint64)
        assert R.multikey_quicksort(group, digits).tolist() == np.lexsort((*digits.T[::-1], group)).tolist()


def test_windows_of_a_split_group(monkeypatch):
    monkeypatch.setattr(R, "TASK_WINDOWS", 40)  # several chunks a task
    rng = random.Random(8)
    text = "".join(rng.choice("abcd") for _ in range(130)).encode()
    bodies = [(i, text[i % 3 : 120 + i % 2] if i % 4 else text[:110] + b"%03d" % i) for i in range(12)]
    rows = [(i, (5 << 16) | (len(b) - R.WINDOW), b) for i, b in bodies]
    ord_, a, body = (list(x) for x in zip(*rows))
    out = list(R.windows_of([R.batch_of("ord a body", ord_, a, body)]))
    runs = [r for b in out for r in b.to_pylist() if r["window"] is None]
    firsts = sorted((r["window"], r["ord"], r["start"]) for b in out for r in b.to_pylist() if r["window"] is not None)
    merged = list(R.again_windows([R.batch_of("window ord start", *(list(x) for x in zip(*part))) for part in (firsts[:7], firsts[7:])]))
    covered = {(r["ord"], s) for r in runs + [r for b in merged for r in b.to_pylist()] for s in range(r["start"], r["stop"] - R.WINDOW + 1)}
    seen, expected = set(), set()
    for i, b in bodies:
        for s in range(len(b) - R.WINDOW + 1):
            if b[s : s + R.WINDOW] in seen:
                expected.add((i, s + 5))
            seen.add(b[s : s + R.WINDOW])
    assert covered == expected and len(out) > 4


def test_sorting_of_suffixes():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(200)]
    strings += [s[:50] + b"c" * 10 for s in strings[:80]] + strings[:30]
    order, prefix = R.blind_trie(strings)
    assert [strings[i] for i in order] == sorted(strings)
    lcp = lambda a, b: next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    assert prefix[1:] == [lcp(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    group = np.array([rng.randrange(3) for _ in strings])
    order, prefix = R.deep_shallow(group, np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), -1).copy()[:, :60])
    pairs = [(group[i], strings[i]) for i in order]
    assert pairs == sorted(pairs)
    assert prefix[1:].tolist() == [lcp(a[1], b[1]) if a[0] == b[0] else -1 for a, b in zip(pairs, pairs[1:])]


def test_least_of_windows():
    h = np.array([5, 3, 3, 9, 1, 1, 7, 2, 2, 8], dtype=np.uint64)
    for span in (1, 2, 3, 5, 10):
        assert R.sliding_least(h, span).tolist() == [i + int(np.argmin(h[i : i + span])) for i in range(len(h) - span + 1)]


# --- near-duplicates -------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_the_full_table():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        b = list(a)
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
        ha, hb = (next(N.word_hashes(pa.array([" ".join(x)]))) for x in (a, b))
        ia, ib = N.items_of(ha), N.items_of(hb)
        m = lcs(ia.tolist(), ib.tolist())
        true = m / (len(ia) + len(ib) - m) if len(ia) or len(ib) else 1.0
        got = N.similarity(ia, ib)
        assert (got >= 0.8) == (true >= 0.8) and (got < 0.8 or got == pytest.approx(true))


def brute_classes(rows):
    items = {}
    for k, (_, t) in enumerate(rows):
        items[k] = N.items_of(next(N.word_hashes(pa.array([t or ""])))).tolist()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(items, 2):
        x, y = items[a], items[b]
        if not x and not y:
            same = True
        elif min(len(x), len(y)) < 0.8 * max(len(x), len(y)):
            same = False
        else:
            m = lcs(x, y)
            same = m / (len(x) + len(y) - m) >= 0.8
        if same:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(find(k)) for k in range(len(rows))]


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(40, 120))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append(" ".join(copy))
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


def test_near_duplicates_against_brute_force(spark):
    rows = [*near_copies(9), (500, None), (501, ""), (502, "one two"), (503, "one  two"), (504, "one three"), (505, "w " * 5000), (505, "w " * 5000), (None, "lonely words of a null id here")]
    df = docs(spark, rows).withColumn("root", F.lit(1)).withColumn("node", F.lit("clash"))
    got = N.near_duplicates(df).collect()
    assert sorted((repr(r.doc_id), r.class_id) for r in got if r.doc_id is not None) == sorted((repr(i), c) for (i, _), c in zip(rows, brute_classes(rows)) if i is not None)
    assert sum(r.kept for r in got) == len({r.class_id for r in got}) and len(got) == len(rows)
    assert N.near_duplicates(docs(spark, [])).collect() == []


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(150)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, prose(rng, 80)) for i in range(100)]
    got = {r.doc_id: r for r in N.near_duplicates(docs(spark, rows)).collect()}
    assert {got[i].class_id for i in range(400)} == {0} and all(got[1000 + i].class_size == 1 for i in range(100))
    kept = N.drop_near_copies(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and kept.count() == 101


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 301)]
    got = {r.node: r.root for r in N.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[150] == got[200] == got[100] == 100 and got[301] == 300


# --- nearest neighbours -----------------------------------------------------------


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=16).astype(np.float32).tolist() for i in range(300)}
    vectors |= {301: None, 302: [0.0] * 16, 303: [float("nan")] * 16, 304: [1.0] * 8, 320: [2.0] * 8, 305: [None] + [1.0] * 15, 306: [float("inf")] * 16}
    vectors |= {400 + i: vectors[7] for i in range(30)}  # ties
    vectors |= {440: [5e-324] * 16, 441: [5e-324] * 16}  # shorter than a scale of theirs
    rows = [(i, v, 0) for i, v in vectors.items()] + [(None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash"))
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: v for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    dot = lambda a, b: sum(x * y for x, y in zip(map(float, a), map(float, b)))
    for q in [i for i in good if i % 20 == 0]:
        best = sorted((-dot(good[q], v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
        found = sorted(got[q])
        assert [n for _, n, _ in found] == [n for _, n in best] and [x for _, _, x in found] == pytest.approx([-x for x, _ in best])
    assert set(got) == {i for i in good if i % 20 == 0}
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_nearest_of_large_and_of_alike_vectors(spark):
    rng = np.random.default_rng(3)
    huge = [(i, (rng.normal(size=4) * 1e160).tolist()) for i in range(60)]
    got = nearest(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect()
    assert len(got) == 60 and {r["rank"] for r in got} == set(range(1, 21))
    near = rng.normal(size=8)
    close = [(i, (near + rng.normal(size=8) * 1e-3).tolist()) for i in range(400)] + [(400 + i, near.tolist()) for i in range(300)]
    vectors = dict(close)
    df = spark.createDataFrame(close, "vec_id long, embedding array<double>").repartition(7)
    found = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in [i for i in vectors if i % 20 == 0]:
        best = sorted((-sum(x * y for x, y in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:20]
        assert [n for _, n in sorted(found[q])] == [n for _, n in best]


def test_nearest_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
