"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, WHITE_RUN, content_key, materialize, one_of_alike, shuffle_partitions, text_or_empty

#: Runs that one merge takes: a round does three binomial steps (2 ** 3).
FAN_IN_BITS = 3


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text_col), WHITE_RUN, " ")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space is one
    space. Of equal texts the smallest id stays.

    Each scan partition is a node that holds a run of digests, sorted and
    combined (smallest identifier, count). In every round a node joins its
    binomial partners (the nodes that differ in the lowest three bits), which
    send their runs to one parent; the parent merges them in digest order and
    keeps the smallest identifier of each digest. The digests are dealt
    into slices and each slice has a tree of its own, so the roots are as many
    tasks as there are slices. Besides SHA-256, a run carries the text's byte length and a
    64-bit hash of another family: identifiers merge only where all three agree.
    The answer goes back through the leaf runs (node, digest), which spreads a
    digest that a third of the rows share over all nodes.

    Null text counts as empty, and empty texts are equal to one another. A null
    id sorts last, so it is kept only if the whole group has null ids. Rows that
    repeat an id are told apart by a row number: exactly one row of a group has
    ``kept``. An empty table gives an empty result. Other columns are neither read
    nor kept.
    """
    spark = docs.sparkSession
    bits = max(3, (shuffle_partitions(spark) - 1).bit_length())
    nodes = 1 << bits
    digests = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("t")).select(
            "doc_id",
            F.unhex(F.sha2("t", 256)).alias("digest"),
            F.octet_length("t").alias("n_bytes"),
            F.xxhash64("t").alias("check"),
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().alias("node"),
        ),
        "digests",
    ).withColumn("node", F.pmod("node", F.lit(nodes)))
    key = ["digest", "n_bytes", "check"]
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")
    slices = 4 * nodes
    in_slice = F.pmod("check", F.lit(slices)).alias("slice")
    leaves = digests.groupBy(in_slice, "node", *key).agg(smallest, F.count(F.lit(1)).alias("n"))
    runs, left = leaves, bits
    while left > 0:
        left -= FAN_IN_BITS
        runs = (
            runs.withColumn("node", F.shiftright("node", FAN_IN_BITS))
            .repartition(nodes, "slice", "node")
            .sortWithinPartitions("slice", "node", *key)
            .groupBy("slice", "node", *key)
            .agg(F.min("least").alias("least"), F.sum("n").alias("n"))
        )
    roots = runs.select(*key, "least", "n")
    verdict = (
        leaves.select("node", *key)
        .join(roots, key)
        .select("node", *key, F.col("least.doc_id").alias("keep_id"), F.col("least.row").alias("keep_row"), F.col("n").alias("group_size"))
    )
    return digests.join(verdict, ["node", *key]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the copies: same columns, one row for each distinct text.

    Rows are found again by their id and digest, so nothing is copied and ``docs``
    may be read in any order. Edge cases as in :func:`exact_dedup`.
    """
    kept = exact_dedup(docs, text_col, id_col).where("kept").select(content_key(F.col("doc_id"), F.col("text_sha256")).alias(KEY))
    keyed = docs.withColumn(KEY, content_key(F.col(id_col), F.sha2(normalised(text_col), 256)))
    return one_of_alike(keyed.join(materialize(kept, "kept"), KEY, "left_semi"), KEY)
