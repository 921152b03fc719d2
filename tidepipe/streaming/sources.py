"""Unbounded sources and rate limits on Structured Streaming."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import json as J
from ..sources.readers import location


def tick(spark: SparkSession, interval_ms: int) -> DataFrame:
    """0, 1, 2, ...: one for each interval, with its time. Columns ``value, timestamp``.

    The rate source counts whole rows a second, so it makes one for each common part
    of the interval and a second, and every n-th of them is a tick: the interval is
    exact whatever it is.
    """
    if interval_ms <= 0:
        raise ValueError("interval must be positive")
    part = gcd(interval_ms, 1000)
    every = interval_ms // part
    rows = spark.readStream.format("rate").option("rowsPerSecond", 1000 // part).load()
    return rows.where(F.col("value") % every == 0).select((F.col("value") / every).cast("long").alias("value"), "timestamp")


def lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """New text files of a folder, a line a row; ``max_files`` a micro-batch is the throttle."""
    reader = spark.readStream
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).text(location(folder))


def jsonl(spark: SparkSession, folder: str, schema: str | None = None, max_files: int | None = None) -> DataFrame:
    """Results of the lines, in the column ``value``."""
    return lines(spark, folder, max_files).where("trim(value) <> ''").select(J.decode(F.col("value"), schema).alias("value"))


def records(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(location(folder))


#: Seconds in the units of a rate.
UNITS = {"per_second": 1, "per_minute": 60, "per_hour": 3600}


def throttled(writer: DataStreamWriter, rate: int, unit: str = "per_second", batch: int = 1) -> DataStreamWriter:
    """At most ``rate`` micro-batches of ``batch`` source units in the unit of time, by the trigger's interval."""
    if rate <= 0:
        raise ValueError("rate must be positive")
    return writer.trigger(processingTime=f"{max(1, round(1000 * UNITS[unit] * batch / rate))} milliseconds")
