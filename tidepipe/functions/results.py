"""Result and Option: ``struct<is_ok, ok, err>`` and ``struct<is_some, value>``.

A nullable column is an Option too, where the payload itself is never null.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

Fn = Callable[[Column], Column]


def result(is_ok: Column, value: Any, error: Any) -> Column:
    return F.struct(is_ok.alias("is_ok"), F.when(is_ok, col(value)).alias("ok"), F.when(~is_ok, col(error)).alias("err"))


def ok(value: Any, err_type: str = "string") -> Column:
    return F.struct(F.lit(True).alias("is_ok"), col(value).alias("ok"), F.lit(None).cast(err_type).alias("err"))


def err(error: Any, ok_type: str = "string") -> Column:
    return F.struct(F.lit(False).alias("is_ok"), F.lit(None).cast(ok_type).alias("ok"), col(error).alias("err"))


def map_ok(r: Column, f: Fn) -> Column:
    return F.struct(r["is_ok"].alias("is_ok"), F.when(r["is_ok"], f(r["ok"])).alias("ok"), r["err"].alias("err"))


def map_err(r: Column, f: Fn) -> Column:
    return F.struct(r["is_ok"].alias("is_ok"), r["ok"].alias("ok"), F.when(~r["is_ok"], f(r["err"])).alias("err"))


def then(r: Column, f: Fn) -> Column:
    """f gives a Result of the same types of error."""
    nxt = f(r["ok"])
    return F.struct(
        (r["is_ok"] & nxt["is_ok"]).alias("is_ok"),
        F.when(r["is_ok"] & nxt["is_ok"], nxt["ok"]).alias("ok"),
        F.when(~r["is_ok"], r["err"]).when(~nxt["is_ok"], nxt["err"]).alias("err"),
    )


def unwrap_or(r: Column, default: Any) -> Column:
    return F.when(r["is_ok"], r["ok"]).otherwise(col(default))


ok_or = unwrap_or


def is_ok(r: Column) -> Column:
    return r["is_ok"]


def is_err(r: Column) -> Column:
    return ~r["is_ok"]


def unwrap(r: Column) -> Column:
    return F.when(r["is_ok"], r["ok"]).otherwise(F.raise_error(F.lit("unwrap called on Err or None")))


def some(value: Any) -> Column:
    return F.struct(F.lit(True).alias("is_some"), col(value).alias("value"))


def none(kind: str) -> Column:
    return F.struct(F.lit(False).alias("is_some"), F.lit(None).cast(kind).alias("value"))


def option_map(o: Column, f: Fn) -> Column:
    return F.struct(o["is_some"].alias("is_some"), F.when(o["is_some"], f(o["value"])).alias("value"))


def option_unwrap_or(o: Column, default: Any) -> Column:
    return F.when(o["is_some"], o["value"]).otherwise(col(default))


def option_unwrap(o: Column) -> Column:
    return F.when(o["is_some"], o["value"]).otherwise(F.raise_error(F.lit("unwrap called on Err or None")))


def is_some(o: Column) -> Column:
    return o["is_some"]


def is_none(o: Column) -> Column:
    return ~o["is_some"]


def to_result(o: Column, error: Any) -> Column:
    return result(o["is_some"], o["value"], error)
