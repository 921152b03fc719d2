"""Sinks. Folders of part files by default, written in parallel; ``single`` gives one file in order.

Every form is made of lines that tasks render by the type of the elements, so a
folder and a single file hold the same text. JSON, tables and Markdown are one
document: a local one is a file, in another store it is a folder whose parts, one
after the other, are the document. The driver never sees more than a line.
"""

from __future__ import annotations

import gzip
import json
import math
import sys
import time
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import render
from ..operators.stream import Stream
from ..sources.readers import location

FORMATS = ("text", "jsonl", "json", "json_pretty", "csv", "tsv", "table", "markdown")
DOCUMENTS = ("json", "json_pretty", "table", "markdown")
#: Most times that a write is tried again, and the seconds before the first of them.
MOST_RETRIES, FIRST_PAUSE = 10, 0.5


def show(x: Any) -> str:
    """The printed text of a value that is on the driver."""
    if x is None:
        return "nil"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        text = format(Decimal(repr(x)), "f") if math.isfinite(x) else repr(x)
        return text if "." in text or not math.isfinite(x) else text + ".0"
    if isinstance(x, Row):
        if all(n == f"_{i}" for i, n in enumerate(x.__fields__, 1)):
            return "(" + ", ".join(map(show, x)) + ")"
        x = x.asDict()
    if isinstance(x, dict):
        return "{" + ", ".join(f"{show(k)}: {show(v)}" for k, v in x.items()) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(show, x)) + "]"
    return str(x)


def pieces_of(values: Iterable[Any], fmt: str, indent: int = 2) -> Iterator[str]:
    """A JSON document of values that are on the driver, an element at a time."""
    pad = "\n" + " " * indent if fmt == "json_pretty" else ""
    n = -1
    yield "["
    for n, v in enumerate(values):  # a string's own line ends are escaped
        text = json.dumps(v, ensure_ascii=False, indent=indent if pad else None, separators=None if pad else (",", ":"))
        yield ("," if n else "") + pad + text.replace("\n", pad)
    yield ("\n" if pad and n >= 0 else "") + "]\n"


def cells(stream: Stream) -> list[tuple[str, Column]]:
    """(name, text) of each column of a tabular form; null is empty.

    The columns are a record's fields or the keys of the first map. An element of
    another kind is one column.
    """
    kind, value = stream.kind, F.col("value")
    if isinstance(kind, T.StructType):
        fields = [(f.name, value[f.name], f.dataType) for f in kind.fields]
    elif isinstance(kind, T.MapType):
        fields = [(str(k), F.try_element_at(value, F.lit(k)), kind.valueType) for k in stream.first() or {}]
    else:
        fields = [("value", value, kind)]
    return [(name, F.when(x.isNull(), F.lit("")).otherwise(render.text(x, of))) for name, x, of in fields]


def elements(df: DataFrame, kind: T.DataType) -> tuple[DataFrame, T.DataType]:
    """A list's elements, one a row, for JSON Lines; other elements as they are."""
    if not isinstance(kind, T.ArrayType):
        return df, kind
    items = F.when(F.col("value").isNull(), F.array(F.lit(None).cast(kind.elementType))).otherwise(F.col("value"))
    return df.withColumn("value", F.explode(items)), kind.elementType


def separated(texts: list[Column], delimiter: str) -> Column:
    """Cells of comma-separated values in a line, quoted where they must be."""
    special = "[" + "".join("\\" + c for c in (delimiter, '"')) + "\r\n]"
    quoted = [F.when(t.rlike(special), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in texts]
    return F.concat_ws(delimiter, *quoted)


def tabbed(texts: list[Column]) -> Column:
    return F.concat_ws("\t", *[F.translate(t, "\t\r\n", "   ") for t in texts])


def laid_out(texts: list[Column], width: list[int], fmt: str) -> Column:
    """Cells side by side, each as wide in bytes as its column."""
    padded = [F.concat(t, F.repeat(F.lit(" "), F.lit(w) - F.octet_length(t))) for t, w in zip(texts, width, strict=True)]
    if fmt == "table":
        return F.rtrim(F.concat_ws("  ", *padded))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *padded), F.lit(" |"))


def widths(df: DataFrame, columns: list[tuple[str, Column]], fmt: str, header: bool) -> list[int]:
    """The widest cell of each column in bytes, by one aggregate."""
    least = 3 if fmt == "markdown" else 0
    found = df.agg(*[F.coalesce(F.max(F.octet_length(t)), F.lit(0)) for _, t in columns]).first()
    titled = header or fmt == "markdown"
    return [max(least, w, len(name.encode()) if titled else 0) for (name, _), w in zip(columns, found, strict=True)]


def lines(stream: Stream, fmt: str, header: bool = True, delimiter: str = ",", indent: int = 2) -> tuple[list[str], DataFrame, list[str]]:
    """(lines before, one line ``value`` for each element in the stream's order, lines after)."""
    df, kind = stream.df.orderBy(*stream.by()).select("value"), stream.kind
    if fmt == "text":
        return [], df.select(render.text(F.col("value"), kind).alias("value")), []
    if fmt == "jsonl":
        df, kind = elements(df, kind)
        return [], df.select(render.json(F.col("value"), kind).alias("value")), []
    if fmt in ("json", "json_pretty"):
        rows = stream.indexed().df  # each but the first has a comma before it
        pretty = fmt == "json_pretty"
        text = render.json(F.col("value"), kind, indent if pretty else None, 1)
        comma = F.when(F.col("_o0") == 0, F.lit("")).otherwise(F.lit(","))
        if not pretty:
            return ["["], rows.orderBy("_o0").select(F.concat(comma, text).alias("value")), ["]"]
        # A comma ends the line before, so it stands in front of the line end.
        return ["["], rows.orderBy("_o0").select(F.concat(F.lit(" " * indent), text, F.lit("")).alias("value"), comma.alias("comma")), ["]"]
    columns = cells(stream)
    names, texts = [name for name, _ in columns], [t for _, t in columns]
    if fmt in ("csv", "tsv"):
        laid = (lambda ts: separated(ts, delimiter)) if fmt == "csv" else tabbed
        return ([_constant(df, laid([F.lit(n) for n in names]))] if header else []), df.select(laid(texts).alias("value")), []
    if not names or not df.take(1):
        return [], df.select(F.lit("").alias("value")).limit(0), []
    width = widths(df, columns, fmt, header)
    before = [_constant(df, laid_out([F.lit(n) for n in names], width, fmt))] if header or fmt == "markdown" else []
    if fmt == "markdown":
        before.append("| " + " | ".join("-" * w for w in width) + " |")
    return before, df.select(laid_out(texts, width, fmt).alias("value")), []


def _constant(df: DataFrame, x: Column) -> str:
    return df.sparkSession.range(1).select(x).first()[0]


def document(stream: Stream, fmt: str, header: bool = True, delimiter: str = ",", indent: int = 2) -> Iterator[str]:
    """The text of a form, a line at a time, on the driver."""
    before, rows, after = lines(stream, fmt, header, delimiter, indent)
    if fmt == "json":
        yield from (*before, *(r["value"] for r in rows.toLocalIterator()), after[0] + "\n")
    elif fmt == "json_pretty":
        n = -1
        for n, r in enumerate(rows.toLocalIterator()):
            yield ("," if n else "[") + "\n" + r["value"]
        yield "[]\n" if n < 0 else "\n]\n"
    else:
        yield from (line + "\n" for line in before)
        yield from (r["value"] + "\n" for r in rows.toLocalIterator())


def folder_document(stream: Stream, fmt: str, header: bool, delimiter: str, indent: int) -> DataFrame:
    """The lines of a document as one ordered DataFrame, for a folder of parts."""
    before, rows, after = lines(stream, fmt, header, delimiter, indent)
    if "comma" in rows.columns:
        rows = rows.select(F.concat("comma", "value").alias("value"))
    spark = stream.spark
    fixed = lambda texts, place: spark.createDataFrame([(place, i, t) for i, t in enumerate(texts)], "_p int, _n long, value string")
    ordered = rows.withColumns({"_p": F.lit(1), "_n": F.monotonically_increasing_id()})  # rows come sorted, part by part
    return fixed(before, 0).unionByName(ordered).unionByName(fixed(after, 2)).orderBy("_p", "_n").select("value")


def attempt(write: Callable[[], None], retry: int) -> None:
    """``write``, tried again up to ``retry`` times, with ever longer pauses, where Spark or the store fails."""
    for n in range(min(max(retry, 0), MOST_RETRIES) + 1):
        try:
            return write()
        except (PySparkException, OSError):
            if n == min(max(retry, 0), MOST_RETRIES):
                raise
            time.sleep(FIRST_PAUSE * 2**n)


def sink(
    stream: Stream,
    dest: str,
    fmt: str = "text",
    append: bool = False,
    header: bool = True,
    delimiter: str = ",",
    indent: int = 2,
    compress: str | None = None,
    single: bool = False,
    retry: int = 0,
    timeout: int | None = None,
) -> None:
    """Writes the stream; ``dest`` is a location, ``stdout`` or ``stderr``.

    ``retry`` is how often a write to a folder is tried again. Spark's stores have
    timeouts of their own, so ``timeout`` is read and has no effect.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    if dest.startswith(("http://", "https://")):
        raise ValueError("HTTP sink not supported")
    if timeout is not None and timeout <= 0:
        raise ValueError("timeout must be positive")
    delimiter, indent = delimiter[:1] or ",", indent if 0 <= indent <= 16 else 2
    path = dest.removeprefix("file://").removeprefix("fs://")
    local = "://" not in path
    if dest in ("stdout", "stderr"):
        getattr(sys, dest).writelines(document(stream, fmt, header, delimiter, indent))
    elif local and (single or fmt in DOCUMENTS):
        with (gzip.open if compress == "gzip" else open)(path, "at" if append else "wt", encoding="utf-8") as out:
            out.writelines(document(stream, fmt, header, delimiter, indent))
    elif single:
        raise ValueError("a single file is written where the driver runs; write a folder to other stores")
    else:
        attempt(lambda: _folder(stream, location(dest), fmt, append, header, delimiter, indent, compress), retry)


def _folder(stream: Stream, where: str, fmt: str, append: bool, header: bool, delimiter: str, indent: int, compress: str | None) -> None:
    if fmt in ("csv", "tsv"):
        df = stream.df.orderBy(*stream.by()).select(*[t.alias(name) for name, t in cells(stream)])
        if fmt == "tsv":
            df = df.select(*[F.translate(F.col(f"`{c}`"), "\t\r\n", "   ").alias(c) for c in df.columns])
    elif fmt in DOCUMENTS:
        df = folder_document(stream, fmt, header, delimiter, indent)
    else:
        df = lines(stream, fmt)[1]
    writer = df.write.mode("append" if append else "overwrite")
    if compress:
        writer = writer.option("compression", compress)
    if fmt == "csv":
        writer.options(header=header, sep=delimiter, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(where)
    elif fmt == "tsv":
        writer.options(header=header, sep="\t", quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(where)
    else:
        writer.text(where)
