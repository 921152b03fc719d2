"""Each stage of the pipeline against brute force on its own input."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidepipe.llm import near_dedup as N
from tidepipe.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = re.compile(r"[\x20\x09-\x0D]+")
PLANTED = [(9001, None), (9002, ""), (9003, "12 34 -- 56"), (9004, "漢字" * 40), (None, "The a of in the that it is and for the on with as was of the to.")]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before, between and after the stages."""
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    first = real.union(spark.createDataFrame([(i, t, "en", None, None) for i, t in PLANTED], SCHEMA)).union(real.limit(5))
    path, frames = tmp_path_factory.mktemp("steps"), [first]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], DATA).write.parquet(f"{path}/{k}")
        frames.append(spark.read.parquet(f"{path}/{k}"))
    assert all(sorted(f.columns) == sorted(first.columns) for f in frames[:-1])
    return [[tuple(r) for r in f.select(*(first.columns if k < 5 else f.columns)).collect()] for k, f in enumerate(frames)]


def test_language_rejects_only_what_is_no_language(steps):
    before, after = Counter(steps[0]), Counter(steps[1])
    assert not after - before
    gone = before - after
    assert {9001, 9002, 9003, 9004} <= {r[0] for r in gone} and None not in {r[0] for r in gone}
    # Prose: most of its marks are words of letters.
    prose = [r for r in gone if r[1] and len(re.findall(r"\b[^\W\d_]{2,}\b", r[1])) > 0.8 * len(r[1].split())]
    assert not [r for r in prose if r[0] not in (9004,)]


def test_exact_dedup_keeps_the_smallest_of_equal_texts(steps):
    groups = {}
    for r in steps[1]:
        groups.setdefault(WHITE.sub(" ", r[1] or ""), []).append(r)
    smallest = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert Counter(steps[2]) == Counter(smallest) and len(smallest) < len(steps[1])


def test_near_dedup_keeps_one_of_each_class(steps):
    rows = sorted(steps[2], key=lambda r: (r[0] is None, r[0] or 0))
    hashes = {}
    items = [N.items_of(np.array([hashes.setdefault(w, zlib.crc32(w.encode()) * 2654435761 + len(w)) for w in WHITE.sub(" ", r[1] or "").split(" ") if w], dtype=np.uint64)) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if min(len(items[a]), len(items[b])) >= 0.8 * max(len(items[a]), len(items[b])) and N.similarity(items[a], items[b]) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    firsts = [rows[k] for k in range(len(rows)) if find(k) == k]
    assert Counter(steps[3]) == Counter(firsts) and len(firsts) < len(rows)


def test_mix_repeats_whole_documents_towards_the_targets(steps):
    before, after = Counter(steps[3]), Counter(steps[4])
    assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    size = sum(words(r) * n for r, n in before.items())
    largest = max(words(r) for r in before)
    assert abs(sum(words(r) * n for r, n in after.items()) - 1.5 * size) <= 0.05 * 1.5 * size + 2 * largest


def test_packing_holds_every_token_once(steps):
    tok = Tokenizer.from_file(tokenizer_path())
    expected = Counter()
    for r in steps[4]:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected.update((r[0], k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter(r[:5] for r in steps[5]) == expected
    held = {}
    for *_, length, _, sequence, offset in steps[5]:
        held.setdefault(sequence, []).append((offset, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r[3] for r in steps[5]) // 2048) + 2


@pytest.mark.parametrize("k", range(4))
def test_stages_on_empty_tables_and_clashing_columns(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    real = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    assert stage(spark, real.limit(0), DATA).collect() == [], name
    odd = real
    for c in ("row", "digest", "node", "root", "bucket", "size", "shard", "kept", "t", "host", "declared", "block"):
        odd = odd.withColumn(c, F.lit("clash"))
    got = stage(spark, odd, DATA)
    assert got.columns == odd.columns and {r.node for r in got.collect()} == {"clash"}, name


def test_rows_alike_in_id_and_text_are_chosen_by_content(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", s, n) for s in ("x", "y", "z") for n in (1, 2)], SCHEMA)
    for k in (1, 2):
        kept = [corpus_pipeline.STAGES[k][1](spark, d, DATA).collect() for d in (docs.repartition(1), docs.orderBy(F.desc("n_chars")).repartition(5, "source"))]
        assert len(kept[0]) == 1 and kept[0] == kept[1]
