"""List and tuple functions on arrays and structs. Indexes start at 0; what is not there is null."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col

Fn = Callable[[Column], Column]


def get(xs: Column, i: Any) -> Column:
    return F.get(xs, col(i))


def set_at(xs: Column, i: Any, v: Any) -> Column:
    """A copy with one element replaced; out of range is an error."""
    i = col(i)
    fits = (i >= 0) & (i < F.size(xs))
    return F.when(fits, F.transform(xs, lambda x, k: F.when(k == i, col(v)).otherwise(x))).otherwise(F.raise_error(F.lit("index out of bounds")))


def append(xs: Column, v: Any) -> Column:
    return F.array_append(xs, col(v))


def length(xs: Column) -> Column:
    return F.size(xs)


def map_(xs: Column, f: Fn) -> Column:
    return F.transform(xs, f)


def filter_(xs: Column, p: Fn) -> Column:
    return F.filter(xs, lambda x: F.coalesce(p(x), F.lit(False)))


def filter_map(xs: Column, f: Fn) -> Column:
    """Nulls are skipped."""
    return F.filter(F.transform(xs, f), lambda x: x.isNotNull())


def reduce(xs: Column, init: Any, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(xs, col(init), f)


def sort(xs: Column) -> Column:
    """Ascending, nulls first."""
    return F.sort_array(xs)


def sort_by(xs: Column, key: Fn) -> Column:
    """Stable, ascending by key."""
    keyed = F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda z: z["v"])


def reverse(xs: Column) -> Column:
    return F.reverse(xs)


def zip_(a: Column, b: Column) -> Column:
    """Pairs, up to the shorter list."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("_1"), y.alias("_2")))


def flatten(xs: Column) -> Column:
    """One level; null inner lists add nothing."""
    return F.flatten(F.filter(xs, lambda x: x.isNotNull()))


def contains(xs: Column, v: Any) -> Column:
    return F.exists(xs, lambda x: x.eqNullSafe(col(v)))


def avg(xs: Column) -> Column:
    """Null for the empty list."""
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(xs) > 0, total / F.size(xs))


def tuple_of(*items: Any) -> Column:
    return F.struct(*[col(v).alias(f"_{i}") for i, v in enumerate(items, 1)])


def tuple_get(t: Column, i: int, arity: int) -> Column:
    return t[f"_{i + 1}"] if 0 <= i < arity else F.lit(None)
