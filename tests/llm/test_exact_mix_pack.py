"""Exact dedup, source mixing and packing: contracts, edge cases and brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tidepipe.llm.exact_dedup import drop_exact_copies, exact_dedup
from tidepipe.llm.mixing import mix_documents, mix_sources, sainte_lague
from tidepipe.llm.packing import WordIds, best_configuration, pack_documents, plan_sequences, solve
from tidepipe.llm.queries import tokenizer_path
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 9000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA)


EDGE = [(3, "a  b", "x"), (1, "a\tb", "x"), (2, None, None), (5, "", "y"), (4, " ", "y"), (None, "a b", "x"), (1, "a\tb", "x"), (7, LONG, None), (8, "é b", "é")]


def test_exact_dedup_against_brute_force(spark):
    got = exact_dedup(docs(spark, EDGE)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in EDGE:
        groups[norm(t)].append(i)
    expected = sorted((repr(i), min(x for x in groups[norm(t)] if x is not None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in EDGE)
    assert sorted((repr(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(docs(spark, [])).collect() == []
    assert [r.keep_id for r in exact_dedup(docs(spark, [(None, "z", "x"), (None, "z", "x")])).collect()] == [None, None]


def test_drop_exact_copies_keeps_columns(spark):
    kept = drop_exact_copies(docs(spark, EDGE).withColumn("digest", F.lit(1)).withColumn("node", F.lit("n")))
    assert kept.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "digest", "node"]
    assert kept.count() == 5 and {1, 2, 7, 8} <= {r.doc_id for r in kept.collect()}


def test_many_copies_of_one_text(spark):
    got = exact_dedup(docs(spark, [(i, "same text" if i % 3 else f"text {i}", "s") for i in range(3000)]))
    assert got.where("group_size = 2000 AND keep_id = 1").count() == 2000


def fill(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2.0 * sizes[s] for s in stopped)
        live = sum(w[s] for s in names if s not in stopped)
        target = {s: 2.0 * sizes[s] if s in stopped else w[s] * rest / live for s in names}
        over = {s for s in names if s not in stopped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        stopped |= over


def test_mix_against_water_filling(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), [None, "a", "b", "c", "d", "é", "A"][min(6, int(rng.exponential(2)))]) for i in range(600)]
    df = docs(spark, [*rows, (None, None, None), (5, "", "zero")]).withColumn("size", F.lit("clash")).withColumn("target", F.lit(0))
    got = mix_sources(df).toPandas()
    sizes = got.groupby("source", dropna=False)["size"].sum()
    sizes = {None if s != s or s is None else s: int(n) for s, n in sizes.items()}
    target = fill(sizes)
    for s, g in got.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert g["source_size"].iloc[0] == sizes[s] and g["target"].iloc[0] == pytest.approx(target[s])
        assert abs(g["taken"].sum() - target[s]) <= max(70, 0.02 * target[s])
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    again = mix_sources(df.repartition(7)).toPandas()
    assert sorted(zip(got["doc_id"].fillna(-1), got["taken"])) == sorted(zip(again["doc_id"].fillna(-1), again["taken"]))
    assert mix_sources(docs(spark, [])).collect() == [] and mix_sources(docs(spark, [(1, None, None)])).first().taken == 0


def test_sainte_lague_against_highest_quotients(spark):
    rng = np.random.default_rng(8)
    for seats in (1, 7, 100, 1234):
        votes = {f"p{i:02d}": float(v) for i, v in enumerate(rng.exponential(100, 17))}
        won = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max(votes, key=lambda s: (votes[s] / (2 * won[s] + 1), [-ord(c) for c in s]))
            won[best] += 1
        frame = spark.createDataFrame(list(votes.items()), "name string, votes double")
        assert {r.name: r.n for r in sainte_lague(frame, F.lit(seats), "votes", "name", "n").collect()} == won


def test_mixed_documents(spark):
    rows = [(i, "w " * (i % 50), "abc"[i % 3]) for i in range(300)]
    got = mix_documents(docs(spark, rows))
    assert got.columns == docs(spark, []).columns
    copies = got.groupBy("doc_id").count().collect()
    assert max(r["count"] for r in copies) <= 2 and got.where("text = ''").count() == 6


def test_words_give_the_tokenizers_ids():
    ids = WordIds(tokenizer_path())
    texts = ["a<|endoftext|>b <|ENDOFTEXT|> don't x's", "ΑΣ Σ ςσ", "é x\x1cy", "İstanbul 12 34ab ab12", "—***—a", "it's 'tis 'S we're", " a\u0085b", "ﬁ ½ ² µ ª º ÿ ß ẞ", "", " \n ", "a-b_c'd", "日本語 テスト", "...'re", "THE!! end.%%%"]
    assert [np.frombuffer(b, "<u4").tolist() for b in ids(texts)] == [e.ids for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_configurations():
    assert best_configuration(np.array([3.0, 2.0]), [6, 4], 10) == {6: 1, 4: 1}
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 3000):
        lengths = np.minimum(rng.lognormal(4, 1, n).astype(int) + 1, 256)
        counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
        held = defaultdict(int)
        used = 0
        for times, config in plan_sequences(counts, 256):
            assert sum(k * v for k, v in config.items()) <= 256
            used += times
            for k, v in config.items():
                held[k] += v * times
        assert dict(held) == counts and used <= 1.03 * lengths.sum() / 256 + 2


def test_configurations_place_nearly_all_pieces():
    rng = np.random.default_rng(7)
    lengths = np.minimum(rng.lognormal(6, 0.7, 10000).astype(int) + 1, 2048)
    counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    assert len(counts) > 1300
    placed, rest, bound = solve(counts, 2048)
    pieces = sum(k * times for config, times in placed.items() for _, k in config)
    assert pieces >= 0.9 * len(lengths) and len({n for config in placed for n, _ in config}) >= 0.98 * len(counts)
    assert sum(placed.values()) + sum(rest.values()) <= 1.001 * bound
    placed, rest, bound = solve({1000: 1000, 1100: 1000}, 2048)
    assert placed == {((1000, 2),): 500, ((1100, 1),): 1000} and not rest and bound == 1500


def test_pack_round_trip(spark):
    rows = [(i, "Some words, and more! " * (i % 40), "s") for i in range(200)] + [(500, LONG, "s"), (None, None, None), (1, "x", "s"), (1, "x", "s")]
    got = pack_documents(docs(spark, rows).withColumn("length", F.lit("clash")), tokenizer_path()).toPandas()
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    expected = []
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected += [(-1 if i is None else i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(expected)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum().to_numpy()[:-1]])).all() and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1
    assert pack_documents(docs(spark, []), tokenizer_path()).collect() == []


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op6_nearest_neighbours"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = entry.queries()[name](spark, data)
    result = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr(list(r)) for r in result.fetchall())
