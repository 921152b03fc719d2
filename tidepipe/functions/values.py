"""Scalar operators and control expressions on columns.

Equality is null-safe and never equates NaN with itself; truth is everything but
null and false; integer division truncates. ANSI mode gives the errors of
overflow and division by zero.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import render


def col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def equal(a: Any, b: Any, floats: bool = False) -> Column:
    same = col(a).eqNullSafe(col(b))
    return same & ~F.coalesce(F.isnan(col(a)), F.lit(False)) if floats else same


def truthy(x: Column, boolean: bool = True) -> Column:
    return F.coalesce(x, F.lit(False)) if boolean else x.isNotNull()


def int_div(a: Any, b: Any) -> Column:
    """Truncates towards zero; division by zero is an error."""
    return F.call_function("div", col(a), col(b))


def concat(a: Any, b: Any) -> Column:
    return F.concat(col(a), col(b))


def if_else(condition: Column, then: Any, otherwise: Any = None) -> Column:
    return F.when(condition, col(then)).otherwise(col(otherwise))


class Bind:
    """A name for what stands at its place in a pattern; see :class:`Match`."""

    def __init__(self, name: str):
        self.name = name


class Rest(Bind):
    """A name for the rest of a list; only as the last of a list's patterns."""


#: Fits everything and names nothing.
ANY = Bind("_")


def fit(pattern: Any, value: Column) -> tuple[Column, dict[str, Column]]:
    """(whether the pattern fits, what its names are bound to)."""
    if isinstance(pattern, Bind):
        return F.lit(True), {pattern.name: value}
    if isinstance(pattern, (tuple, list, dict)):
        if isinstance(pattern, tuple):
            fits, parts = value.isNotNull(), [(p, value[f"_{i}"]) for i, p in enumerate(pattern, 1)]
        elif isinstance(pattern, dict):
            fits, parts = value.isNotNull(), [(p, value[k]) for k, p in pattern.items()]
        else:
            rest = pattern[-1] if pattern and isinstance(pattern[-1], Rest) else None
            firsts = pattern[:-1] if rest else pattern
            fits = list_of(len(firsts), rest is not None)(value)
            parts = [(p, F.get(value, F.lit(i))) for i, p in enumerate(firsts)]
            if rest:
                parts.append((rest, F.slice(value, F.lit(len(firsts) + 1), F.greatest(F.size(value) - len(firsts), F.lit(0)))))
        names: dict[str, Column] = {}
        for p, v in parts:
            ok, bound = fit(p, v)
            fits, names = fits & ok, names | bound
        return fits, names
    return (pattern(value) if callable(pattern) else value.eqNullSafe(F.lit(pattern))), {}


class Names:
    """The columns that a pattern has bound, as attributes."""

    def __init__(self, bound: dict[str, Column]):
        self.__dict__.update(bound)


class Match:
    """``match(x).arm(pattern, result, when=guard)...``: the first arm that fits wins.

    A pattern is a literal (null-safe equality), a function of the value that gives
    a boolean column, a tuple, list or dict of patterns for tuples, lists and
    records, or ``Bind(name)`` for anything; ``Rest(name)`` ends a list of any
    length. A result is a value or a function of the value, and a guard such a
    function; where the pattern binds names, both get them instead:
    ``arm((0, Bind("y")), lambda b: b.y)``.
    """

    def __init__(self, value: Column):
        self.value, self.arms = value, []

    def arm(self, pattern: Any, result: Any, when: Callable[[Any], Column] | None = None) -> Match:
        fits, bound = fit(pattern, self.value)
        given = Names(bound) if bound else self.value
        if when:
            fits = fits & F.coalesce(when(given), F.lit(False))
        self.arms.append((fits, col(result(given) if callable(result) else result)))
        return self

    def otherwise(self, result: Any) -> Column:
        last = col(result(self.value) if callable(result) else result)
        for fits, value in reversed(self.arms):
            last = F.when(fits, value).otherwise(last)
        return last

    def end(self) -> Column:
        """No arm fits: an error."""
        return self.otherwise(F.raise_error(F.lit("no matching pattern")))


def match(value: Column) -> Match:
    return Match(value)


def list_of(n: int, rest: bool = False) -> Callable[[Column], Column]:
    """Pattern of a list of n elements, or of n and a rest."""
    return lambda x: F.coalesce(F.size(x) >= n if rest else F.size(x) == n, F.lit(False))


def variant(tag: str) -> Callable[[Column], Column]:
    """Pattern of a tagged value."""
    return lambda x: x["tag"].eqNullSafe(F.lit(tag))


def tagged(tag: str, **payload: Any) -> Column:
    """A value of an algebraic type: its tag and its payload."""
    return F.struct(F.lit(tag).alias("tag"), *[col(v).alias(k) for k, v in payload.items()])


def field(x: Column, *path: str) -> Column:
    """Nested fields; null on the way gives null."""
    for p in path:
        x = x[p]
    return x


def variant_field(x: Column, path: str, kind: str) -> Column:
    """A field of a JSON value of no fixed shape; null where it is missing or of another kind."""
    return F.try_variant_get(x, path, kind)


def record(**fields: Any) -> Column:
    return F.struct(*[col(v).alias(k) for k, v in fields.items()])


def spread(base: Column, **fields: Any) -> Column:
    """The record with fields replaced in place or appended."""
    for k, v in fields.items():
        base = base.withField(k, col(v))
    return base


def type_of(x: Column) -> Column:
    return F.typeof(x)


def check(condition: Column) -> Column:
    return F.assert_true(F.coalesce(condition, F.lit(False)))


def panic(message: Any) -> Column:
    return F.raise_error(col(message))


def to_text(x: Column, kind: T.DataType | str = "string") -> Column:
    """The text of a value of type ``kind``, nested or not: null is ``nil``, whole doubles end in ``.0``, none has an exponent."""
    return render.text(x, kind)
