"""Language identification by fusing text, declared language, address and host.

The posterior of a language is its prior at the document's host, times the
chance of the declared language under it, times the likelihood of the text's
byte trigrams. Host priors are counts by grouped aggregation, smoothed towards
those of the address suffix, which are smoothed towards those of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, content_key, materialize, text_or_empty
from .html_text import extract_pages
from .textbatch import text_chunks

#: Most labelled rows of each language that the trigram model is fitted on.
TRAINING_ROWS = 1500
BUCKETS = 1 << 16
#: Weight of the level above when a host's or a suffix's counts are smoothed.
STRENGTH = 20.0
#: A document is rejected when its best posterior is lower, or when more of its trigrams are unknown.
LEAST_POSTERIOR, MOST_UNKNOWN = 0.6, 0.5
#: Texts that are lower-cased at a time.
LOWERED = 1000
#: Added to the number of trigrams, so that a few words are not rejected for being rare.
FEW = 5


def trigrams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, trigram buckets, bounds) of lower-case texts, chunk by chunk; trigrams cross no document."""
    for first in range(0, len(texts), LOWERED):
        for row, data, offsets in text_chunks(pc.utf8_lower(texts.slice(first, LOWERED).fill_null(""))):
            yield first + row, *trigrams_of(data, offsets)


def trigrams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram buckets, bounds) of one chunk."""
    wide = data.astype(np.uint32)
    grams = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) if len(data) > 2 else np.zeros(0, np.uint32)
    inside = np.ones(len(grams), dtype=bool)
    for back in (1, 2):
        edge = offsets[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(inside))]] = False
    bounds = np.concatenate([[0], np.cumsum(inside)])[np.minimum(offsets, len(inside))]
    buckets = (grams[inside] * np.uint32(2654435761)) >> np.uint32(16)
    return buckets, bounds


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each declared language: how often a bucket occurs, and in how many texts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang in pc.unique(batch["declared"]).to_pylist():
            own = batch.filter(pc.equal(batch["declared"], lang))
            total = counts.setdefault(lang, np.zeros((2, BUCKETS), np.int64))
            for _, buckets, bounds in trigrams(own["t"]):
                total[0] += np.bincount(buckets, minlength=BUCKETS)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    total[1, np.unique(buckets[a:b])] += 1
    for lang, total in counts.items():
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["declared", "bucket", "n", "texts"])


def fit_trigrams(docs: DataFrame, languages: list[str], training_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood of each bucket and language, whether a language knows the bucket: has it in a tenth of its texts, three at most)."""
    declared = F.col("declared")
    there = {r["declared"]: r["n"] for r in docs.where(declared.isin(*languages)).groupBy("declared").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*[F.when(declared == lang, F.lit(0.9 * training_rows / n if n > training_rows else 1.0)) for lang, n in there.items()], F.lit(0.0))
    chosen = F.pmod(F.xxhash64(F.lit(23), "row"), F.lit(1 << 30)) < share * float(1 << 30)
    rows = docs.where(declared.isin(*languages)).where(chosen).select("declared", "t").mapInArrow(count_trigrams, "declared string, bucket long, n long, texts long")
    counts, known = np.zeros((BUCKETS, len(languages))), np.zeros(BUCKETS, dtype=bool)
    enough = {lang: min(3, -(-n // 10)) for lang, n in there.items()}
    for r in rows.groupBy("declared", "bucket").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).collect():  # at most BUCKETS a language
        known[r["bucket"]] |= r["texts"] >= enough[r["declared"]]
        counts[r["bucket"], languages.index(r["declared"])] = r["n"]
    shares = (counts + 0.2) / (counts.sum(axis=0) + 0.2 * BUCKETS)
    return np.log(shares).astype(np.float32), known


def identify_language(
    docs: DataFrame,
    languages: tuple[str, ...] = ("de", "en", "es", "fr"),
    text_col: str = "text",
    id_col: str = "doc_id",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    suffix_col: str | None = None,
    row_col: str | None = None,
    training_rows: int = TRAINING_ROWS,
) -> DataFrame:
    """One row per input row: ``doc_id, lang, posterior, text_lang, unknown, accepted``.

    The trigram model is fitted on a sample by hash of the rows that declare a
    language, nine tenths of ``training_rows`` each so that chance stays below it; priors and the reliability of declarations are counted over all
    rows. A row is rejected if its text has no letter, if over half of its trigrams
    are unknown to every language, or if the best posterior is low.

    Null text counts as empty: no evidence from the text, ``lang`` is what the
    other evidence says and the row is rejected. A null or unheard-of declaration,
    a null suffix and a null host are values of their own. Ties go to the language
    that comes first. Repeated rows get equal answers. An empty table gives an
    empty result. Extra columns are ignored.
    """
    languages = sorted(languages)
    n_lang = len(languages)
    lit_or = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.col(row_col) if row_col else F.xxhash64(id_col, text_col)).cast("string").alias("row"),
        text_or_empty(text_col).alias("t"),
        F.lower(F.substring(lit_or(declared_col), 1, 2)).alias("declared"),
        lit_or(host_col).alias("host"),
        lit_or(suffix_col).alias("suffix"),
    )
    table, known = fit_trigrams(plain, languages, training_rows)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            likely, unknown = np.zeros((n, n_lang)), np.ones(n)
            for row, buckets, bounds in trigrams(batch["t"]):
                sums = np.zeros((len(buckets) + 1, n_lang + 1))
                np.cumsum(table[buckets], axis=0, out=sums[1:, :n_lang], dtype=np.float64)
                np.cumsum(~known[buckets], out=sums[1:, n_lang])
                own = sums[bounds[1:]] - sums[bounds[:-1]]
                likely[row : row + len(own)] = own[:, :n_lang]
                count = np.diff(bounds)
                unknown[row : row + len(own)] = own[:, n_lang] / (count + FEW)
            letters = pc.match_substring_regex(batch["t"], r"\pL").fill_null(False).to_numpy(zero_copy_only=False)
            best = likely.argmax(axis=1)
            out = [batch[c] for c in ("doc_id", "row", "declared", "host", "suffix")]
            out += [pa.array(list(likely), pa.list_(pa.float64())), pa.array(np.where(letters, unknown, 1.0)), pa.array(best, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "row", "declared", "host", "suffix", "likely", "unknown", "text_best"])

    weighed = materialize(plain.mapInArrow(weigh, "doc_id long, row string, declared string, host string, suffix string, likely array<double>, unknown double, text_best int"), "weighed")
    said = F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise(F.when(F.col("declared").isNull(), F.lit("none")).otherwise(F.lit("other"))).alias("said")
    sure = weighed.where(F.col("unknown") <= MOST_UNKNOWN)
    counts = [F.count_if(F.col("text_best") == i).cast("double") for i in range(n_lang)]

    # Global counts and the reliability of declarations: a few numbers.
    total = np.ones(n_lang)
    spoken = {s: np.full(n_lang, 0.5) for s in [*languages, "none", "other"]}
    for r in sure.groupBy(said).agg(F.array(*counts).alias("n")).collect():
        total += np.array(r["n"])
        spoken[r["said"]] += np.array(r["n"])
    says = sum(spoken.values())
    top = [float(x) for x in total / total.sum()]
    smooth = lambda own, above: F.transform(F.arrays_zip(own.alias("x"), above.alias("y")), lambda z: z["x"] + STRENGTH * z["y"])
    share = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda a, b: a + b))
    hosts = sure.groupBy("suffix", "host").agg(F.array(*counts).alias("n"))
    suffixes = hosts.groupBy("suffix").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(n_lang)]).alias("m"))
    suffixes = suffixes.select(F.col("suffix").alias("suffix_"), share(smooth(F.col("m"), F.array(*map(F.lit, top)))).alias("above"))
    priors = hosts.join(suffixes, F.col("suffix").eqNullSafe(F.col("suffix_"))).select(F.col("host").alias("host_"), "suffix_", share(smooth(F.col("n"), F.col("above"))).alias("prior"))

    # AQE broadcasts the priors where they are small and splits a hot host where they are not.
    fused = weighed.join(priors, F.col("host").eqNullSafe(F.col("host_")) & F.col("suffix").eqNullSafe(F.col("suffix_")), "left").withColumn("prior", F.coalesce("prior", F.array(*map(F.lit, top))))
    words = F.coalesce(*[F.when(said == s, F.array(*[F.lit(float(np.log(p))) for p in spoken[s] / says])) for s in spoken])
    logs = F.array(*[F.col("likely")[i] + F.log(F.col("prior")[i]) + words[i] for i in range(n_lang)])
    fused = fused.withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    place = F.array_position("logs", F.col("most")).cast("int")
    names = F.array(*map(F.lit, languages))
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    return fused.select(
        "doc_id",
        F.element_at(names, place).alias("lang"),
        posterior.alias("posterior"),
        F.element_at(names, F.col("text_best") + 1).alias("text_lang"),
        "unknown",
        ((posterior >= LEAST_POSTERIOR) & (F.col("unknown") <= MOST_UNKNOWN)).alias("accepted"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """``pages`` as documents: ``doc_id, text, declared, host, suffix`` from url and html.

    The text is the page's main text, ``declared`` the language its html element
    names, the suffix the host's last label and the path's first segment if that
    has two letters. Null url and html give null evidence and an empty text.
    """
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    segment = F.regexp_extract("url", r"://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    return extract_pages(pages).select(
        F.col("page_id").alias("doc_id"),
        "text",
        F.nullif(F.regexp_extract("markup_lang", "^[A-Za-z]+", 0), F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"),
        F.concat_ws("/", F.nullif(F.element_at(F.split(host, r"\."), -1), F.lit("")), F.nullif(segment, F.lit(""))).alias("suffix"),
    )


def identify_pages(pages: DataFrame, languages: tuple[str, ...] = ("de", "en", "es", "fr")) -> DataFrame:
    """:func:`identify_language` of pages from all evidence: text, markup, address suffix and host. ``page_id`` instead of ``doc_id``."""
    evidence = materialize(page_evidence(pages), "evidence")
    return identify_language(evidence, languages, declared_col="declared", host_col="host", suffix_col="suffix").withColumnRenamed("doc_id", "page_id")


def keep_identified(docs: DataFrame, languages: tuple[str, ...] = ("de", "en", "es", "fr")) -> DataFrame:
    """``docs`` without the rejected rows: same columns.

    Rejected rows, mostly few, are found again by a key of their evidence; rows
    alike in it have the same fate. Edge cases as in :func:`identify_language`.
    """
    keyed = docs.withColumn(KEY, content_key(F.col("doc_id"), F.xxhash64("text", "lang", "source").cast("string")))
    rejected = identify_language(keyed, languages, row_col=KEY).where("NOT accepted").select(KEY).distinct()
    return keyed.join(materialize(rejected, "rejected"), KEY, "left_anti").drop(KEY)
