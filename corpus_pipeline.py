"""The corpus pipeline: five operators of ``tidepipe.llm`` in a row.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it
kept and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepipe.llm import common, queries
from tidepipe.llm.exact_dedup import drop_exact_copies
from tidepipe.llm.language import keep_identified
from tidepipe.llm.mixing import mix_documents
from tidepipe.llm.near_dedup import drop_near_copies
from tidepipe.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot say what language identification, Order MinHash and packing do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = common.materialize(docs, name)
    return docs
