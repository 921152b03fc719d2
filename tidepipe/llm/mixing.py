"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks.

DataFrame functions only: no Python, pandas, Arrow or RDD code on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, content_key, materialize, one_of_alike, text_or_empty

#: Documents that a shard holds on average in a large corpus; in a small one shards
#: are smaller, down to LEAST_DOCS, until there are SOME_SHARDS.
SHARD_DOCS, LEAST_DOCS, SOME_SHARDS = 4096, 128, 512
TIMES = "__tidepipe_times"


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, repeats: float) -> DataFrame:
    """Water filling: adds ``target`` to rows of (source, source_size).

    Weights go round by the source's code points, null last. Targets share
    ``share`` times the sum of sizes by weight; those beyond ``repeats`` times
    their size stop there and the rest is shared again. Sources that stop are the
    first ones by capacity over weight, so running sums find them in one pass. It
    works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    everything = Window.partitionBy()
    filled = sources.withColumns({"weight": weight, "cap": repeats * F.col("source_size").cast("double")})
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumns(
        {
            "total": share * F.sum("source_size").over(everything).cast("double"),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    ).withColumn("stops", F.col("weight") * (F.col("total") - F.col("cap_before")) > F.col("cap") * F.col("weight_left"))
    rest = F.col("total") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything)
    weights_left = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything)
    return filled.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * rest / weights_left)).select("source", "source_size", "target")


def sainte_lague(parties: DataFrame, seats: Column, votes: str, name: str, out: str) -> DataFrame:
    """Adds ``out``: the seats of each row by the highest quotients votes / (2k - 1).

    Seats are numbered k = 1, 2, ...; ties go to the smaller ``name``, null last.
    With P rows the divisor that spends all seats lies between those of
    ``seats - P/2`` and ``seats + P/2``: every row gets what the lower one gives
    at once, and only the quotients between the two, at most 2 P of them, are
    ranked. ``seats`` must be the same in every row.
    """
    everything = Window.partitionBy()
    total, p = F.sum(votes).over(everything), F.count(F.lit(1)).over(everything)
    rate = lambda shift: F.greatest(F.lit(0.0), (F.col("seats") + shift * (p / 2 + 1)) / total)
    at = lambda shift: F.coalesce(F.floor(F.col(votes) * rate(shift) + 0.5), F.lit(0)).cast("long")
    parties = parties.withColumn("seats", seats)
    bounds = parties.withColumns({"sure": F.when(total > 0, at(-1)).otherwise(F.lit(0)), "most": F.when(total > 0, at(1)).otherwise(F.lit(0))})
    bounds = bounds.withColumn("left", F.col("seats") - F.sum("sure").over(everything))
    ranked = bounds.where("most > sure").select(name, votes, "left", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("k"))
    order = Window.orderBy((F.col(votes) / (2 * F.col("k") - 1)).desc(), F.col(name).isNull(), name, "k")
    won = ranked.withColumn("rank", F.row_number().over(order)).where("rank <= left").groupBy(name).agg(F.count(F.lit(1)).alias("won"))
    return bounds.alias("b").join(won.alias("w"), F.col(f"b.{name}").eqNullSafe(F.col(f"w.{name}")), "left").select("b.*", (F.col("sure") + F.coalesce("won", F.lit(0))).alias(out)).drop("sure", "most", "left", "seats")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: float = 2.0,
    block_words: int = 64,
    seed: int = 17,
    row_col: str | None = None,
) -> DataFrame:
    """How many words of each document a mix takes.

    Returns ``doc_id, size, source_size, target, taken`` (and ``source``, and
    ``row_col`` if given). Blocks of ``block_words`` words (fewer where a source
    is so small that blocks would be coarse) are apportioned to the sources by
    Sainte-Laguë on their targets. A source's documents are dealt into shards by
    a seeded hash of id, size and text; each shard's words, in a seeded order, are cut into blocks and
    the source's quota is split over its shards in whole blocks. A shard takes
    each block as often as its quota goes round, and the rest by a seeded rotation
    of evenly spaced blocks, whose count within a document is a closed form: no
    block is ever a row. The same seed gives the same mix whatever the
    partitioning.

    A null text has size 0; a null source is a source of its own, last in order.
    Null and repeated ids are counted as rows of their own; rows alike in id, text
    and source may swap their taken words, which no result can tell. Sources of
    size 0 get the target 0. An empty table gives an empty result. Extra columns
    are ignored.
    """
    sized = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(text_or_empty()).alias("size"),
            F.xxhash64("text").alias("mark"),
            *([row_col] if row_col else []),
        ),
        "sizes",
    )
    n = sized.count()
    shards = max(1, n // SHARD_DOCS, min(n // LEAST_DOCS, SOME_SHARDS))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "mark", *([row_col] if row_col else [])), F.lit(shards)))
    shard_sizes = sized.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    sources = source_targets(shard_sizes.groupBy("source").agg(F.sum("shard_size").alias("source_size")), weights, share, repeats)

    everything = Window.partitionBy()
    smallest = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everything)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.coalesce(smallest, F.lit(1)) / (200 * shards)))).cast("long"))
    sources = sainte_lague(sources, F.round(F.sum("target").over(everything) / F.col("block")).cast("long"), "target", "source", "quota")

    along = Window.partitionBy("source").orderBy("shard")
    to_here = along.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    plan = (
        shard_sizes.alias("h")
        .join(sources.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
        .select("h.source", "h.shard", "s.source_size", "s.target", "s.block", "s.quota", F.ceil(F.col("h.shard_size") / F.col("s.block")).alias("blocks"))
    )
    plan = plan.withColumns({"blocks_all": F.sum("blocks").over(whole), "blocks_to": F.sum("blocks").over(to_here)})
    # The last block of a shard is short, so the quota's words take a few blocks more;
    # beyond what the blocks hold they would repeat a document too often.
    needed = F.when(F.col("source_size") > 0, F.round(F.col("quota") * F.col("block") * F.col("blocks_all") / F.col("source_size"))).otherwise(F.lit(0))
    quota = F.least(needed, F.floor(F.col("blocks_all") * repeats)).cast("long")
    up_to = lambda b: F.when(F.col("blocks_all") > 0, F.floor(b.cast("decimal(38,0)") * quota.cast("decimal(38,0)") / F.col("blocks_all"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("shard_quota", up_to(F.col("blocks_to")) - up_to(F.col("blocks_to") - F.col("blocks")))
    plan = plan.withColumns(
        {
            "rounds": F.when(F.col("blocks") > 0, F.expr("shard_quota div blocks")).otherwise(F.lit(0)).cast("long"),
            "extra": F.when(F.col("blocks") > 0, F.col("shard_quota") % F.col("blocks")).otherwise(F.lit(0)).cast("long"),
            "turn": F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("blocks"))).otherwise(F.lit(0)),
        }
    ).select("source", "shard", "source_size", "target", "block", "blocks", "rounds", "extra", "turn")

    in_shard = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "mark"), F.col("doc_id").isNull(), "doc_id", "size", "mark", *([row_col] if row_col else []))
    placed = sized.withColumn("stop", F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)))
    both = placed.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.shard") == F.col("p.shard"))).drop(F.col("p.source")).drop(F.col("p.shard"))

    def words_before(x: Column) -> Column:
        """Words before ``x`` in chosen blocks: block j is one if (j * extra + turn) mod blocks < extra."""
        chosen = lambda j: F.when(F.col("blocks") > 0, F.floor((j * F.col("extra") + F.col("turn") + F.col("blocks") - 1) / F.col("blocks"))).otherwise(F.lit(0)).cast("long")
        j = F.expr("0L") + F.floor(x / F.col("block")).cast("long")
        return F.col("block") * chosen(j) + (x - j * F.col("block")) * (chosen(j + 1) - chosen(j))

    taken = F.col("rounds") * F.col("size") + words_before(F.col("stop")) - words_before(F.col("stop") - F.col("size"))
    return both.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", *([row_col] if row_col else []))


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` as the mix repeats or leaves them out: same columns.

    A document that gives ``taken`` of its ``size`` words appears taken div size
    times, and once more with the chance that the rest stands for, by a seeded
    hash. Documents of no words stay once: they add nothing to any source. Edge
    cases as in :func:`mix_sources`.
    """
    keyed = docs.withColumn(KEY, content_key(F.col("doc_id"), F.xxhash64("text", "source").cast("string")))
    mix = mix_sources(keyed, seed=seed, row_col=KEY)
    chance = F.pmod(F.xxhash64(F.lit(seed + 2), KEY, "taken"), F.lit(1 << 30)) / float(1 << 30)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + chance)).cast("int")
    # Rows alike in id, text and source are taken together.
    mix = mix.groupBy(KEY).agg(F.sum(times).alias(TIMES)).where(F.col(TIMES) > 0)
    mixed = one_of_alike(keyed.join(materialize(mix, "times"), KEY), KEY)
    return mixed.withColumn("__tidepipe_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(TIMES)))).drop(TIMES, "__tidepipe_copy")
