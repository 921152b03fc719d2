"""String functions: lengths in bytes, letter case for ASCII only."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def split(s: Column, sep: str) -> Column:
    """By a literal separator; empty pieces stay; the empty separator gives single characters."""
    if sep == "":
        return F.filter(F.split(s, ""), lambda x: x != "")
    return F.split(s, r"\Q" + sep + r"\E", -1)


def trim(s: Column) -> Column:
    """Spaces, tabs and line ends only."""
    return F.btrim(s, F.lit(" \t\n\r"))


def join(items: Column, sep: str) -> Column:
    return F.array_join(items.cast("array<string>"), sep, "nil")


def contains(s: Column, part: Any) -> Column:
    return F.contains(s, _col(part))


def replace(s: Column, old: Any, new: Any) -> Column:
    return F.replace(s, _col(old), _col(new))


def starts_with(s: Column, prefix: Any) -> Column:
    return F.startswith(s, _col(prefix))


def ends_with(s: Column, suffix: Any) -> Column:
    return F.endswith(s, _col(suffix))


#: Runs of ASCII and of other characters.
RUNS = r"[\x00-\x7f]+|[^\x00-\x7f]+"


def _cased(s: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` for the ASCII letters of a text: the whole of it at once if it is ASCII, else run by run."""
    ascii_ = lambda x: F.octet_length(x) == F.char_length(x)
    runs = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(RUNS), F.lit(0)), lambda r: F.when(ascii_(r), change(r)).otherwise(r)), "")
    return F.when(ascii_(s), change(s)).otherwise(runs)


def to_lower(s: Column) -> Column:
    return _cased(s, F.lower)


def to_upper(s: Column) -> Column:
    return _cased(s, F.upper)


def length(s: Column) -> Column:
    return F.octet_length(s)
