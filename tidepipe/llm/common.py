"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import dropped
from ..plans.staging import staged as materialize

__all__ = ["KEY", "WHITE_RUN", "content_key", "dropped", "materialize", "one_of_alike", "shuffle_partitions", "table", "table_join", "text_or_empty"]

#: Java and RE2 spelling of one run of ASCII white space.
WHITE_RUN = r"[\x20\x09-\x0D]+"


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


#: Column in which stages carry the key of a row; dropped again.
KEY = "__tidepipe_key"


def content_key(doc_id: Column, *content: Column) -> Column:
    """A row's key by its id and content, never null; rows alike in both share it."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), *content)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a table of statistics is broadcast, and the parts in which the rows of a hot key meet it beyond that.
BROADCAST_ROWS, SALTS = 100_000, 32


def table_join(rows: DataFrame, statistics: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``statistics``, one row a ``key``; null where the key is unknown.

    ``statistics`` is counted: a small table is broadcast, so ``rows`` are not
    shuffled; a large one meets them in SALTS parts of a key, dealt by ``spread``.
    """
    if statistics.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(statistics), key, "left")
    salt = "__tidepipe_salt"
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(statistics.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, salt], "left").drop(salt)


def one_of_alike(rows: DataFrame, key: str) -> DataFrame:
    """One row of each ``key``, ``key`` dropped: that of the least hash of its other columns, so that the choice does not depend on partitions."""
    columns = [c for c in rows.columns if c != key]
    hashed = [c for c, kind in rows.dtypes if c != key and "map<" not in kind and "variant" not in kind]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    least = F.xxhash64(*[F.col(f"`{c}`") for c in hashed]) if hashed else F.lit(0)
    return rows.groupBy(key).agg(F.min_by(row, least).alias("__tidepipe_row")).select("__tidepipe_row.*")
