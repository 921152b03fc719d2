"""Reading URLs on executors through a Python data source, one partition a URL."""

from __future__ import annotations

import csv
import gzip
import urllib.request
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import json as J
from ..operators.stream import Stream
from .readers import json_elements


class HttpLines(DataSource):
    """Options: ``urls`` (one a line), ``timeout`` in seconds, ``whole`` for a row a body. A response other than 200 is an error."""

    @classmethod
    def name(cls) -> str:
        return "tidepipe_http"

    def schema(self) -> str:
        return "url_index int, line long, value string"

    def reader(self, schema: Any) -> HttpReader:
        return HttpReader(self.options["urls"].split("\n"), float(self.options.get("timeout", "30")), self.options.get("whole") == "true")


class HttpReader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float, whole: bool):
        self.urls, self.timeout, self.whole = urls, timeout, whole

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, u)) for i, u in enumerate(self.urls)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        i, url = partition.value
        with urllib.request.urlopen(url, timeout=self.timeout) as response:  # raises on 4xx and 5xx
            if response.status != 200:
                raise OSError(f"{url}: HTTP {response.status}")
            body = gzip.GzipFile(fileobj=response) if response.headers.get("Content-Encoding") == "gzip" else response
            if self.whole:
                yield i, 0, body.read().decode("utf-8", "replace")
                return
            for n, line in enumerate(body):
                yield i, n, line.decode("utf-8", "replace").rstrip("\n").rstrip("\r")


def http(spark: SparkSession, urls: str | list[str], fmt: str = "text", schema: str | None = None, timeout: float = 30, sep: str = ",") -> Stream:
    """Lines of the URLs as text, or as Results: of JSON Lines, of the elements of JSON, or of the rows of CSV, whose first line names the columns."""
    if fmt not in ("text", "jsonl", "json", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    spark.dataSource.register(HttpLines)
    listed = [urls] if isinstance(urls, str) else urls
    df = spark.read.format("tidepipe_http").options(urls="\n".join(listed), timeout=str(timeout), whole=str(fmt == "json").lower()).load()
    order = [("_o0", True), ("_o1", True)]
    lines = df.select("value", F.col("url_index").alias("_o0"), F.col("line").alias("_o1"))
    if fmt == "text":
        return Stream(lines, order)
    if fmt == "json":
        return json_elements(lines, order, schema)
    if fmt == "csv":
        first = lines.where("_o0 = 0 AND _o1 = 0").first()
        names = next(csv.reader([first["value"]], delimiter=sep), []) if first else []
        if not names:
            raise ValueError("no headers found")
        ddl = ", ".join(f"`{n}` string" for n in names)
        row = F.from_csv("value", ddl, {"sep": sep, "escape": '"', "mode": "PERMISSIVE"})
        value = F.struct(F.lit(True).alias("is_ok"), row.alias("ok"), F.lit(None).cast("string").alias("err"))
        return Stream(lines.where("_o1 > 0 AND value <> ''").select(value.alias("value"), "_o0", "_o1"), order)
    parsed = lines.where("trim(value) <> ''").withColumn("_r", J.decode(F.col("value"), schema, explained=True))
    problem = F.when(~F.col("_r.is_ok"), F.struct(F.col("_r.err.message").alias("message"), (F.col("_o1") + 1).cast("int").alias("line")))
    return Stream(parsed.select(F.struct(F.col("_r.is_ok").alias("is_ok"), F.col("_r.ok").alias("ok"), problem.alias("err")).alias("value"), "_o0", "_o1"), order)
