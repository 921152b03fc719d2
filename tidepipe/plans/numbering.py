"""Numbers and running folds along a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

PART, AT = "_part", "_at"


def laid_out(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-sorted by ``order``, with the number of each row's part and its place in it.

    The parts are written, because two runs of a range sort may cut differently.
    """
    place = F.monotonically_increasing_id()
    return staged(df.orderBy(*order).withColumns({PART: F.spark_partition_id(), AT: place.bitwiseAND((1 << 33) - 1)}), "laid_out")


def part_sizes(parts: DataFrame) -> list[tuple[int, int]]:
    """(part, rows) in order: what reaches the driver is a row for each part of the sort."""
    return sorted((r[PART], r["_count"]) for r in parts.groupBy(PART).agg(F.count(F.lit(1)).alias("_count")).collect())


def numbered(df: DataFrame, order: list[Column], name: str = "_n") -> DataFrame:
    """``df`` with the row's number in ``order``, from 0. The numbers of the parts' first rows are a broadcast row for each part."""
    parts = laid_out(df, order)
    firsts, n = [], 0
    for part, size in part_sizes(parts):
        firsts.append((part, n))
        n += size
    before = df.sparkSession.createDataFrame(firsts, f"{PART} int, _before long")
    return parts.join(F.broadcast(before), PART).withColumn(name, F.col(AT) + F.col("_before")).drop(PART, AT, "_before")


def after(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``df`` without its first ``n`` rows in ``order``: a condition on parts and places, so rows stay where they are."""
    parts = laid_out(df, order)
    sizes, k = part_sizes(parts), 0
    while k < len(sizes) and sizes[k][1] <= n:
        n -= sizes[k][1]
        k += 1
    part = sizes[k][0] if k < len(sizes) else sizes[-1][0] + 1 if sizes else 0
    return parts.where((F.col(PART) > part) | ((F.col(PART) == part) & (F.col(AT) >= n))).drop(PART, AT)


#: Folds that combine: name -> aggregate over values.
COMBINING = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def running(df: DataFrame, order: list[Column], value: Column, fold: str, name: str) -> DataFrame:
    """``df`` with the running ``fold`` of ``value``: within each part, then shifted by the folds of the parts before."""
    agg = COMBINING[fold]
    parts = laid_out(df.withColumn("_v", value), order)
    totals = parts.groupBy(PART).agg(agg("_v").alias("_total"))
    over = F.sum if fold == "count" else agg
    before = totals.select(PART, over("_total").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = agg("_v").over(Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0))
    both = {"sum": F.coalesce(F.col("_before"), F.lit(0)) + F.col("_own"), "count": F.coalesce(F.col("_before"), F.lit(0)) + F.col("_own"), "min": F.least("_before", "_own"), "max": F.greatest("_before", "_own")}[fold]
    return parts.withColumn("_own", own).join(F.broadcast(before), PART).withColumn(name, both).drop(PART, AT, "_v", "_own", "_before")
