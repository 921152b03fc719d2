"""Map functions. Keys keep their order; a key that is set again keeps its place."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col


def get(m: Column, k: Any) -> Column:
    return F.try_element_at(m, col(k))


def merge(a: Column, b: Column) -> Column:
    """b wins; no reliance on the session's policy for repeated keys."""
    kept = F.transform(F.map_entries(a), lambda e: F.struct(e["key"].alias("key"), F.when(F.map_contains_key(b, e["key"]), F.try_element_at(b, e["key"])).otherwise(e["value"]).alias("value")))
    new = F.filter(F.map_entries(b), lambda e: ~F.map_contains_key(a, e["key"]))
    return F.map_from_entries(F.concat(kept, new))


def set_key(m: Column, k: Any, v: Any) -> Column:
    return merge(m, F.create_map(col(k), col(v)))


def delete(m: Column, k: Any) -> Column:
    return F.map_filter(m, lambda key, _: key != col(k))


def keys(m: Column) -> Column:
    return F.map_keys(m)


def values(m: Column) -> Column:
    return F.map_values(m)


def contains(m: Column, k: Any) -> Column:
    """True also where the value is null."""
    return F.map_contains_key(m, col(k))


def length(m: Column) -> Column:
    return F.size(m)
