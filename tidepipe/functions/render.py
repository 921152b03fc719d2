"""Texts of values of any type, as Columns: how a value is printed and how it is written as JSON.

A Column does not know its type, so each function takes it: a DataType or its DDL
text. Both forms are expressions of the JVM; nested values are rendered inside out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integers and whole doubles beyond these have no exact or no short form in JSON.
EXACT, SHORT = 1 << 53, 1e15
NO_NUMBER = "cannot encode NaN or Infinity to JSON"
NO_KEY = "cannot encode map with non-string key to JSON"
NO_BYTES = "cannot encode bytes to JSON"


def type_of(kind: T.DataType | str) -> T.DataType:
    return T.DataType.fromDDL(kind) if isinstance(kind, str) else kind


def is_tuple(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and bool(kind.names) and all(n == f"_{i}" for i, n in enumerate(kind.names, 1))


def is_double(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def digits(x: Column) -> Column:
    """A finite double in decimal digits: no exponent, no point behind whole numbers."""
    text = x.cast("double").cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.ltrim(text, F.lit("-"))
    mantissa, power = F.substring_index(body, "E", 1), F.try_to_number(F.ltrim(F.substring_index(body, "E", -1), F.lit("-")), F.lit("999")).cast("int")
    all_ = F.concat(F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "^0$", ""))
    n = F.length(all_)
    large = F.when(n <= power + 1, F.rpad(all_, power + 1, F.lit("0"))).otherwise(F.concat(F.substring(all_, F.lit(1), power + 1), F.lit("."), F.substring(all_, power + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), power - 1), all_)
    long = F.when(F.contains(body, F.lit("E-")), small).otherwise(large)
    return F.concat(sign, F.when(F.contains(body, F.lit("E")), long).otherwise(F.regexp_replace(body, r"\.0$", "")))


def joined(parts: list[Column | str]) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def text(x: Column, kind: T.DataType | str) -> Column:
    """The printed text, never null: nil, true, 1.0, [1, 2], (1, 2), {k: v}."""
    kind = type_of(kind)
    if is_double(kind):
        d = x.cast("double")
        odd = F.when(F.isnan(d), F.lit("nan")).when(d == float("inf"), F.lit("inf")).when(d == float("-inf"), F.lit("-inf"))
        number = digits(d)
        out = F.coalesce(odd, F.when(F.contains(number, F.lit(".")), number).otherwise(F.concat(number, F.lit(".0"))))
    elif is_tuple(kind):
        out = joined(["(", *_between([text(x[f.name], f.dataType) for f in kind.fields], ", "), ")"])
    elif isinstance(kind, T.StructType):
        out = joined(["{", *_between([F.concat(F.lit(f"{f.name}: "), text(x[f.name], f.dataType)) for f in kind.fields], ", "), "}"])
    elif isinstance(kind, T.ArrayType):
        out = joined(["[", F.array_join(F.transform(x, lambda v: text(v, kind.elementType)), ", "), "]"])
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(text(e["key"], kind.keyType), F.lit(": "), text(e["value"], kind.valueType))
        out = joined(["{", F.array_join(F.transform(F.map_entries(x), entry), ", "), "}"])
    elif isinstance(kind, T.BinaryType):
        out = F.lit("<bytes>")
    elif isinstance(kind, T.VariantType):
        out = F.to_json(x)
    else:
        out = x.cast("string")
    return F.when(x.isNull(), F.lit("nil")).otherwise(out)


def _between(parts: list[Column], sep: str) -> list[Column | str]:
    return [p for part in parts for p in (sep, part)][1:]


def quoted(x: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def json(x: Column, kind: T.DataType | str, indent: int | None = None, level: int = 0) -> Column:
    """Compact JSON, or with ``indent`` spaces a level: whole doubles as integers, tuples as lists, null fields kept.

    What has no JSON (NaN, infinity, bytes, keys that are no strings) is an error; see :func:`unencodable`.
    """
    kind = type_of(kind)
    inner, outer = ("", "") if indent is None else ("\n" + " " * indent * (level + 1), "\n" + " " * indent * level)
    colon = ":" if indent is None else ": "
    deeper = lambda v, k: json(v, k, indent, level + 1)
    if is_double(kind):
        d = x.cast("double")
        out = F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.raise_error(F.lit(NO_NUMBER)).cast("string")).otherwise(digits(d))
    elif isinstance(kind, T.LongType):
        out = F.when(x.between(-EXACT, EXACT), x.cast("string")).otherwise(digits(x.cast("double")))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        out = x.cast("string")
    elif isinstance(kind, T.DecimalType):
        out = F.when(F.contains(x.cast("string"), F.lit(".")), F.regexp_replace(x.cast("string"), r"\.?0+$", "")).otherwise(x.cast("string"))
    elif isinstance(kind, T.StructType):
        left, right = ("[", "]") if is_tuple(kind) else ("{", "}")
        label = lambda name: "" if is_tuple(kind) else _json_text(name) + colon
        parts = [F.concat(F.lit(inner + label(f.name)), deeper(x[f.name], f.dataType)) for f in kind.fields]
        out = joined([left, *_between(parts, ","), outer if parts else "", right])
    elif isinstance(kind, T.ArrayType):
        items = F.array_join(F.transform(x, lambda v: F.concat(F.lit(inner), deeper(v, kind.elementType))), ",")
        out = F.when(F.size(x) == 0, F.lit("[]")).otherwise(joined(["[", items, outer, "]"]))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(F.lit(inner), quoted(e["key"]), F.lit(colon), deeper(e["value"], kind.valueType))
        items = F.array_join(F.transform(F.map_entries(x), entry), ",")
        out = F.when(F.size(x) == 0, F.lit("{}")).otherwise(joined(["{", items, outer, "}"]))
        if not isinstance(kind.keyType, T.StringType):
            out = F.raise_error(F.lit(NO_KEY)).cast("string")
    elif isinstance(kind, T.BinaryType):
        out = F.raise_error(F.lit(NO_BYTES)).cast("string")
    elif isinstance(kind, T.VariantType):
        out = F.to_json(x)
    elif isinstance(kind, T.NullType):
        out = F.lit("null")
    else:
        out = quoted(x.cast("string"))
    return F.when(x.isNull(), F.lit("null")).otherwise(out)


def _json_text(name: str) -> str:
    from json import dumps

    return dumps(name, ensure_ascii=False)


def unencodable(x: Column, kind: T.DataType | str) -> Column:
    """The reason why a value has no JSON; null if it has."""
    kind = type_of(kind)
    if is_double(kind):
        return F.when(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), F.lit(NO_NUMBER))
    if isinstance(kind, T.BinaryType):
        return F.when(x.isNotNull(), F.lit(NO_BYTES))
    if isinstance(kind, T.StructType):
        return reduce(F.coalesce, [unencodable(x[f.name], f.dataType) for f in kind.fields], F.lit(None).cast("string"))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        items, of = (x, kind.elementType) if isinstance(kind, T.ArrayType) else (F.map_values(x), kind.valueType)
        if isinstance(kind, T.MapType) and not isinstance(kind.keyType, T.StringType):
            return F.when(x.isNotNull(), F.lit(NO_KEY))
        return F.get(F.filter(F.transform(items, lambda v: unencodable(v, of)), lambda r: r.isNotNull()), F.lit(0))
    return F.lit(None).cast("string")
