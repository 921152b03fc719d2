"""JSON on columns: decoding to a Result, encoding to text."""

from __future__ import annotations

import json as _json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import render

PROBLEM = "message string, position int"

# What Python's decoder says, and the messages that users know.
MESSAGES = {
    "Expecting property name enclosed in double quotes": "expected string key in object",
    "Expecting ':' delimiter": "expected ':' after object key",
    "Unterminated string starting at": "unterminated string",
    "Invalid control character at": "control character in string",
    "Invalid \\escape": "invalid escape sequence",
    "Invalid \\uXXXX escape": "invalid hex in unicode escape",
    "Extra data": "unexpected content after value",
    "Illegal trailing comma before end of object": "expected string key in object",
    "Illegal trailing comma before end of array": "unexpected character",
}
LITERALS = {"t": "true", "f": "false", "n": "null"}
STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def _refused(name: str) -> None:
    raise ValueError(name)


def problem_of(s: str | None) -> tuple[str, int] | None:
    """(message, position) of the first error of a text, none if it is JSON."""
    if s is None:
        return None
    try:
        _json.loads(s, parse_constant=_refused)
        return None
    except _json.JSONDecodeError as e:
        at, said = e.pos, e.msg
    except (ValueError, RecursionError):
        return "unexpected character", len(s) - len(s.lstrip())
    if said.startswith("Illegal trailing comma"):
        at += 1 + len(s[at + 1 :]) - len(s[at + 1 :].lstrip())
    if said == "Expecting value":
        rest = s[at:].lstrip()
        if not rest:
            return "unexpected end of input", len(s)
        word = LITERALS.get(rest[0])
        return f"invalid literal (expected '{word}')" if word else "expected digit" if rest[0] == "-" else "unexpected character", at
    if said == "Expecting ',' delimiter":
        before = STRING.sub("", s[:at])
        depth, k = 0, len(before) - 1
        while k >= 0 and not (depth == 0 and before[k] in "[{"):
            depth += (before[k] in "]}") - (before[k] in "[{")
            k -= 1
        return "expected ',' or '}' in object" if k >= 0 and before[k] == "{" else "expected ',' or ']' in array", at
    if said == "Extra data" and re.search(r"(?:^|[^\d.])-?0$", s[:at]) and s[at : at + 1].isdigit():
        return "leading zeros not allowed", at
    if said == "Extra data" and s[at : at + 1] == ".":
        return "expected digit after decimal point", at + 1
    return MESSAGES.get(said.split(":")[0] if said.startswith("Invalid") else said, said), at


def _explained(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([problem_of(x) or (None, None) for x in s], columns=["message", "position"]).astype({"position": "Int32"})


def explain(s: Column) -> Column:
    """``struct<message, position>`` of the first error in texts that are no JSON. In Python: apply it to failed rows."""
    return F.pandas_udf(_explained, PROBLEM)(s)


def decode(s: Column, schema: str | None = None, explained: bool = False) -> Column:
    """``struct<is_ok, ok, err struct<message, position>>``.

    Without a schema the value is a VARIANT, of any shape. Errors are all called
    "invalid JSON", at the first character that is not white space, as Spark says
    no more; ``explained`` finds the message and the place of each, for which all
    rows pass a Python worker (good ones as nulls).
    """
    parsed = F.try_parse_json(s)
    good = parsed.isNotNull()
    value = parsed if schema is None else F.when(good, F.from_json(s, schema))
    if explained:
        problem = explain(F.when(~good, s))
    else:
        problem = F.struct(F.lit("invalid JSON").alias("message"), (F.length(s) - F.length(F.ltrim(s))).cast("int").alias("position"))
    return F.struct(good.alias("is_ok"), F.when(good, value).alias("ok"), F.when(~good, problem).alias("err"))


def encode(value: Column, kind: T.DataType | str | None = None, indent: int | None = None) -> Column:
    """The JSON text of a value of type ``kind``; NaN, infinity and keys that are no strings are errors.

    Without ``kind`` Spark's own rules hold, in which doubles keep their exponent.
    """
    return F.to_json(value, {"ignoreNullFields": "false"}) if kind is None else render.json(value, kind, indent)


def try_encode(value: Column, kind: T.DataType | str) -> Column:
    """A Result of the JSON text, or of the reason why there is none."""
    reason = render.unencodable(value, kind)
    return F.struct(reason.isNull().alias("is_ok"), F.when(reason.isNull(), render.json(value, kind)).alias("ok"), reason.alias("err"))


def field(s: Column, path: str) -> Column:
    """A scalar inside JSON text, as text; null where it is missing or the text is not JSON."""
    return F.get_json_object(s, path)
