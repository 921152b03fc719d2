"""Sources: generated sequences, and files read by Spark's readers from any store it knows."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..operators.stream import Stream

#: Schemes of locations as users write them, and as Hadoop's file systems are called.
SCHEMES = {"s3": "s3a", "gs": "gs", "az": "abfss", "file": "file", "fs": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3a": "s3a", "abfss": "abfss"}
FILE_ORDER = [("_o0", True), ("_o1", True), ("_o2", True)]


def location(uri: str, account: str | None = None) -> str:
    """A path for Spark: bare paths stay as they are, unknown schemes are an error."""
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return uri
    if scheme in ("http", "https"):
        raise ValueError("read http with sources.http")
    if scheme not in SCHEMES:
        raise ValueError(f"unsupported URI scheme: {scheme}")
    if scheme == "az" and "@" not in rest.partition("/")[0]:  # az://container/path
        container, slash, path = rest.partition("/")
        account = account or os.environ.get("AZURE_STORAGE_ACCOUNT")
        if not account:
            raise ValueError("az:// needs an account: az://container@account.dfs.core.windows.net/path, or AZURE_STORAGE_ACCOUNT")
        rest = f"{container}@{account}.dfs.core.windows.net{slash}{path}"
    return f"{SCHEMES[scheme]}://{rest}"


def range_(spark: SparkSession, a: int, b: int | None = None, step: int = 1) -> Stream:
    """Half-open; a negative step counts down; step 0 is an error."""
    if step == 0:
        raise ValueError("range step cannot be zero")
    start, stop = (0, a) if b is None else (a, b)
    return Stream(spark.range(start, stop, step).select(F.col("id").alias("value"), (F.col("id") if step > 0 else -F.col("id")).alias("_o0")), [("_o0", True)])


def repeat(spark: SparkSession, value: Any, n: int) -> Stream:
    """The value n times: an endless batch does not exist, so the bound comes with the source."""
    return Stream(spark.range(max(0, n)).select(F.lit(value).alias("value"), F.col("id").alias("_o0")), [("_o0", True)])


#: Values of an iteration that one list holds.
STEPS = 1000


def iterate(spark: SparkSession, init: Any, f: Callable[[Column], Column], n: int) -> Stream:
    """init, f(init), f(f(init)), ...: n of them.

    Each value needs the one before, so lists of STEPS values are made one after the
    other; only a list's last value passes through the driver.
    """
    start = init if isinstance(init, Column) else F.lit(init)
    grow = lambda xs, _: F.concat(xs, F.array(f(F.element_at(xs, -1))))
    done = []
    for first in range(0, max(n, 1), STEPS):
        size = min(STEPS, max(n, 0) - first)
        xs = F.aggregate(F.sequence(F.lit(1), F.lit(size - 1)), F.array(start), grow) if size > 1 else F.array(start)
        some = spark.range(1 if size > 0 else 0).select(xs.alias("xs"))
        done.append(some.select(F.posexplode("xs").alias("_o0", "value")).select((F.col("_o0") + first).cast("long").alias("_o0"), "value"))
        if first + STEPS < n:
            start = F.lit(some.select(f(F.element_at("xs", -1))).first()[0]).cast(done[0].schema["value"].dataType)
    return Stream(reduce(DataFrame.unionByName, done), [("_o0", True)])


def crossing(uri: str) -> tuple[str, str] | None:
    """(folder above the first wildcard, pattern of whole paths) of a glob in an object store, where ``*`` crosses ``/``; none for other locations."""
    scheme, sep, rest = uri.partition("://")
    if scheme not in ("s3", "s3a", "gs", "az", "abfss", "blob") or not set("*?") & set(rest):
        return None
    above = re.split(r"[*?]", rest)[0].rpartition("/")[0]
    pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in rest[len(above) :])
    return f"{scheme}://{above}", pattern + "$"


def _lines(spark: SparkSession, uri: str | list[str], wholetext: bool = False) -> DataFrame:
    uris = [uri] if isinstance(uri, str) else uri
    globs = [g for u in uris if (g := crossing(u))]
    plain = [location(u) for u in uris if not crossing(u)]
    found = [spark.read.text(plain, wholetext=wholetext)] if plain else []
    for above, pattern in globs:  # the condition on the path prunes files
        found.append(spark.read.text(location(above), wholetext=wholetext, recursiveFileLookup=True).where(F.col("_metadata.file_path").rlike(pattern)))
    place = [F.col("_metadata.file_path").alias("_o0"), F.col("_metadata.file_block_start").alias("_o1"), F.monotonically_increasing_id().alias("_o2")]
    return reduce(DataFrame.unionByName, [df.select("value", *place) for df in found])


def text(spark: SparkSession, uri: str | list[str]) -> Stream:
    """A string for each line, in file order; line ends of any kind are cut off, blank lines stay. Globs and folders work; in object stores ``*`` crosses ``/``."""
    return Stream(_lines(spark, uri), FILE_ORDER)


def jsonl(spark: SparkSession, uri: str | list[str], schema: str | None = None, lines: bool = True) -> Stream:
    """A Result for each line that is not blank: the value (of ``schema``, else a VARIANT) or ``{message, line}``.

    Good and bad lines are two readings of the files, so ``filter_ok`` reads once and
    meets no Python. Bad lines alone get the message of what is wrong and the number
    of their line, for which a third reading counts the lines of each split;
    ``lines=False`` leaves the numbers null.
    """
    df = _lines(spark, uri)
    parsed = df.where("trim(value) <> ''").withColumn("_r", J.decode(F.col("value"), schema))
    ok_type = parsed.schema["_r"].dataType["ok"].dataType
    none = F.lit(None).cast("struct<message:string,line:int>")
    order = ["_o0", "_o1", "_o2"]
    good = parsed.where("_r.is_ok").select(F.struct(F.lit(True).alias("is_ok"), F.col("_r.ok").alias("ok"), none.alias("err")).alias("value"), *order)
    bad = parsed.where("NOT _r.is_ok").select("value", *order)
    if lines:
        splits = df.groupBy("_o0", "_o1").agg(F.count(F.lit(1)).alias("_count"), F.min("_o2").alias("_first"))
        before = F.sum("_count").over(Window.partitionBy("_o0").orderBy("_o1").rowsBetween(Window.unboundedPreceding, -1))
        splits = splits.select("_o0", "_o1", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
        bad = bad.join(splits, ["_o0", "_o1"]).withColumn("_line", (F.col("_o2") - F.col("_first") + F.col("_before") + 1).cast("int"))
    else:
        bad = bad.withColumn("_line", F.lit(None).cast("int"))
    bad = bad.withColumn("_said", J.explain(F.col("value")))
    problem = F.struct(F.coalesce("_said.message", F.lit("invalid JSON")).alias("message"), F.col("_line").alias("line"))
    bad = bad.select(F.struct(F.lit(False).alias("is_ok"), F.lit(None).cast(ok_type).alias("ok"), problem.alias("err")).alias("value"), *order)
    return Stream(good.unionByName(bad), FILE_ORDER)


def json(spark: SparkSession, uri: str, schema: str | None = None) -> Stream:
    """A whole file: an Ok for each element of its array, one Ok for any other value, one Err for what is not JSON.

    ``schema`` is that of an element. For files of any size prefer :func:`jsonl`.
    """
    return json_elements(_lines(spark, uri, wholetext=True), FILE_ORDER, schema)


def json_elements(df: DataFrame, order: list[tuple[str, bool]], schema: str | None = None) -> Stream:
    """Results of the elements of whole JSON texts in ``value``."""
    keys, place = [c for c, _ in order], f"_o{len(order)}"
    good = F.try_parse_json("value").isNotNull()
    is_list = F.ltrim("value").startswith("[")
    if schema:
        items = F.when(is_list, F.from_json("value", f"array<{schema}>")).otherwise(F.array(F.from_json("value", schema)))
    else:
        items = F.from_json(F.when(is_list, F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]"))), "array<variant>")
    ok = df.where(good).select(F.posexplode(items).alias(place, "ok"), *keys)
    kind = ok.schema["ok"].dataType.simpleString()
    none = F.lit(None).cast("struct<message:string,position:int>")
    ok = ok.select(F.struct(F.lit(True).alias("is_ok"), F.col("ok"), none.alias("err")).alias("value"), *keys, place)
    bad = df.where(~good).select(F.struct(F.lit(False).alias("is_ok"), F.lit(None).cast(kind).alias("ok"), J.explain(F.col("value")).alias("err")).alias("value"), *keys, F.lit(0).alias(place))
    return Stream(ok.unionByName(bad), [*order, (place, True)])


def csv(spark: SparkSession, uri: str | list[str], sep: str = ",", multiline: bool = False) -> Stream:
    """A Result for each row: records of strings named by the first row; short rows end in nulls, long ones are cut."""
    paths = [location(u) for u in ([uri] if isinstance(uri, str) else uri)]
    df = spark.read.csv(paths, header=True, sep=sep, escape='"', mode="PERMISSIVE", multiLine=multiline, inferSchema=False, enforceSchema=True)
    if not df.columns:
        raise ValueError("no headers found")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    value = F.struct(F.lit(True).alias("is_ok"), row.alias("ok"), F.lit(None).cast("string").alias("err"))
    return Stream(df.select(value.alias("value"), F.col("_metadata.file_path").alias("_o0"), F.col("_metadata.file_block_start").alias("_o1"), F.monotonically_increasing_id().alias("_o2")), FILE_ORDER)


def stdin(spark: SparkSession, lines: Iterable[str] | None = None) -> Stream:
    """The driver's standard input, a string a line: as small as what a person or a shell pipes in."""
    rows = [(i, line.rstrip("\n").rstrip("\r")) for i, line in enumerate(sys.stdin if lines is None else lines)]
    return Stream(spark.createDataFrame(rows, "_o0 long, value string"), [("_o0", True)])


def source(spark: SparkSession, uri: str, fmt: str = "text", **options: Any) -> Stream:
    """One of the readers by name: text, jsonl, json or csv; ``stdin`` is the standard input."""
    if uri == "stdin":
        return stdin(spark)
    if uri.startswith(("http://", "https://")):
        from .http import http

        return http(spark, uri, fmt, **options)
    return {"text": text, "jsonl": jsonl, "json": json, "csv": csv}[fmt](spark, uri, **options)


def env(name: str, default: str | None = None) -> dict | str:
    """A variable of the driver's environment; without it the default, or an Err."""
    if name in os.environ:
        return os.environ[name]
    return default if default is not None else {"is_ok": False, "ok": None, "err": "undefined environment variable"}
