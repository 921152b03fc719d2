"""The ordered pipeline: lazy transforms and terminals over a DataFrame.

A stream is a DataFrame with one column ``value`` (a scalar, a list, a map or a
record) and the columns that order it. Functions get and return Columns, so
Catalyst sees the whole pipeline. Operators that do not need the order leave it
alone: nothing is sorted before a take, drop, zip, batch, scan, first, last,
collect or ordered sink asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.numbering import AT, COMBINING, PART, after, laid_out, numbered, running
from ..plans.staging import staged

Fn = Callable[[Column], Column]
RESULT_FIELDS, OPTION_FIELDS = ("is_ok", "ok", "err"), ("is_some", "value")


def _names(kind: T.DataType) -> tuple[str, ...]:
    return tuple(kind.names) if isinstance(kind, T.StructType) else ()


class Stream:
    """See the module. ``order`` lists (column, ascending); ``df`` has those and ``value``."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame], order: list[tuple[str, bool]], dropped: tuple[Stream, int] | None = None):
        self._df, self.order, self.dropped = df, order, dropped

    @property
    def df(self) -> DataFrame:
        """A drop lays the rows out when they are asked for, so that a take behind it can do without."""
        if callable(self._df):
            self._df = self._df()
        return self._df

    # --- making and leaving -------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, *keys: str) -> Stream:
        """Records of ``df`` in the order of ``keys``, which should tell all rows apart; without keys, in the order of reading."""
        order = [F.col(f"`{k}`") for k in keys] or [F.monotonically_increasing_id()]
        named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
        return cls(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("value"), *named), [(f"_o{i}", True) for i in range(len(named))])

    @classmethod
    def from_list(cls, spark: SparkSession, items: list, schema: str) -> Stream:
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"_o0 long, value {schema}")
        return cls(rows, [("_o0", True)])

    def records(self) -> DataFrame:
        """The elements as a plain DataFrame: a record's fields, or ``value``."""
        return self.df.select("value.*") if _names(self.kind) else self.df.select("value")

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def kind(self) -> T.DataType:
        return self.df.schema["value"].dataType

    def by(self) -> list[Column]:
        """Nulls sort first going up, as the least values, and last going down."""
        return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in self.order]

    def _with(self, df: DataFrame) -> Stream:
        return Stream(df, self.order)

    def _value(self, value: Column) -> Stream:
        return self._with(self.df.select(value.alias("value"), *[c for c, _ in self.order]))

    # --- element by element -------------------------------------------------

    def map(self, f: Fn) -> Stream:
        return self._value(f(F.col("value")))

    def filter(self, p: Fn) -> Stream:
        """Null is false; a condition that is not boolean is true where it is not null."""
        kept = p(F.col("value"))
        boolean = isinstance(self.df.select(kept).schema[0].dataType, T.BooleanType)
        return self._with(self.df.where(kept if boolean else kept.isNotNull()))

    def filter_map(self, f: Fn) -> Stream:
        """Keeps what is not null; of Options, what is there."""
        out = self.map(f)
        if _names(out.kind) == OPTION_FIELDS:
            return out._with(out.df.where("value.is_some")).map(lambda x: x["value"])
        return out._with(out.df.where("value IS NOT NULL"))

    def flat_map(self, f: Fn) -> Stream:
        return self.map(f).flatten()

    def flatten(self) -> Stream:
        """One level of lists; other elements stay as they are."""
        if not isinstance(self.kind, T.ArrayType):
            return self
        place = f"_o{max([int(c[2:]) for c, _ in self.order], default=-1) + 1}"
        df = self.df.select(F.posexplode("value").alias(place, "value"), *[c for c, _ in self.order])
        return Stream(df, [*self.order, (place, True)])

    def tap_each(self, f: Callable[[Any], None]) -> Stream:
        """The same elements; ``f`` is called with each, in the tasks that read it, for its side effects. A task that is run again calls it again."""
        columns = self.df.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for x in batch["value"]:
                    f(x)
                yield batch

        return self._with(self.df.mapInPandas(run, self.df.schema).select(*columns))

    def tap(self, name: str, *metrics: Column) -> tuple[Stream, Observation]:
        """The same elements; the aggregates can be read from the Observation after an action."""
        seen = Observation(name)
        return self._with(self.df.observe(seen, *metrics)), seen

    def tap_err(self, name: str) -> tuple[Stream, Observation]:
        """Counts the errors that pass and keeps the least of their texts."""
        failed = ~F.col("value.is_ok")
        return self.tap(name, F.count_if(failed).alias("errors"), F.min(F.when(failed, F.col("value.err").cast("string"))).alias("sample"))

    def par_map(self, f: Fn, n: int | None = None) -> Stream:
        """Partitions run in parallel as they are; ``n`` asks for that many."""
        return (self._with(self.df.repartition(n)) if n else self).map(f)

    par_map_unordered = par_map

    def par_map_result(self, f: Callable[[Any], Any], kind: str, n: int | None = None) -> Stream:
        """A plain Python function of the element; what it raises becomes an Err of its message."""
        cols, of = [c for c, _ in self.order], self.kind

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ok, out, err = [], [], []
                for x in batch["value"]:
                    try:
                        value, problem = f(x), None
                    except Exception as e:  # noqa: BLE001  the error is the result
                        value, problem = None, str(e)
                    ok.append(problem is None)
                    out.append(value)
                    err.append(problem)
                yield batch[cols].assign(ok_=ok, out_=pd.Series(out, dtype=object), err_=err)

        order = ", ".join(f"{c} {self.df.schema[c].dataType.simpleString()}" for c in cols)
        base = self.df.repartition(n) if n else self.df
        df = base.mapInPandas(run, f"{order}, ok_ boolean, out_ {kind}, err_ string")
        return self._with(df.select(F.struct(F.col("ok_").alias("is_ok"), F.col("out_").alias("ok"), F.col("err_").alias("err")).alias("value"), *cols))

    def buffer(self, n: int) -> Stream:
        """Spark reads ahead on its own: the same elements."""
        return self

    def throttle(self, rate: int, unit: str = "per_second") -> Stream:
        """A batch has no clock: the same elements. See ``streaming.sources.throttled`` for streams."""
        return self

    # --- results ------------------------------------------------------------

    def filter_ok(self) -> Stream:
        return self._with(self.df.where("value.is_ok")).map(lambda r: r["ok"])

    def filter_err(self) -> Stream:
        return self._with(self.df.where("NOT value.is_ok")).map(lambda r: r["err"])

    def partition_result(self) -> dict[str, Stream]:
        """Both branches read one staged copy; elements that are no Results go to ``ok``."""
        if _names(self.kind) != RESULT_FIELDS:
            return {"ok": self, "err": self._with(self.df.limit(0))}
        once = self._with(staged(self.df, "results"))
        return {"ok": once.filter_ok(), "err": once.filter_err()}

    # --- order --------------------------------------------------------------

    def take(self, n: int) -> Stream:
        """A top-k: no full sort. After a drop it takes the first of both and leaves the dropped out."""
        if self.dropped:
            above, k = self.dropped
            return self._with(above.df.orderBy(*self.by()).offset(k).limit(max(0, n)))
        return self._with(self.df.orderBy(*self.by()).limit(max(0, n)))

    def drop(self, n: int) -> Stream:
        """All but the first n; the rows stay spread over the parts of the sort."""
        if n <= 0:
            return self
        above, k = self.dropped or (self, 0)
        return Stream(lambda: after(above.df, above.by(), n + k), self.order, (above, n + k))

    def sort_by(self, key: Fn, descending: bool = False) -> Stream:
        """Stable; descending reverses the ascending result, ties too."""
        name = f"_o{max([int(c[2:]) for c, _ in self.order], default=-1) + 1}"
        order = [(name, not descending), *[(c, up != descending) for c, up in self.order]]
        return Stream(self.df.withColumn(name, key(F.col("value"))), order)

    def distinct(self) -> Stream:
        """The first of equal elements, by value. Combined before the shuffle."""
        if not self.order:
            return self._with(self.df.dropDuplicates(["value"]))
        keys = [c for c, _ in self.order]
        if all(up for _, up in self.order):
            first = F.min(F.struct(*keys))
        elif not any(up for _, up in self.order):
            first = F.max(F.struct(*keys))
        else:
            return self.indexed().distinct()
        return self._with(self.df.groupBy("value").agg(first.alias("_first")).select("value", *[F.col(f"_first.{k}").alias(k) for k in keys]))

    def indexed(self) -> Stream:
        """The same stream, ordered by the numbers of its elements."""
        df = numbered(self.df, self.by()).select("value", F.col("_n").alias("_o0"))
        return Stream(df, [("_o0", True)])

    def zip(self, other: Stream) -> Stream:
        """Pairs (_1, _2) up to the end of the shorter stream."""
        a, b = self.indexed().df, other.indexed().df
        pair = F.struct(F.col("a.value").alias("_1"), F.col("b.value").alias("_2"))
        return Stream(a.alias("a").join(b.alias("b"), "_o0").select("_o0", pair.alias("value")), [("_o0", True)])

    def batch(self, n: int) -> Stream:
        """Lists of n elements; the last may be shorter."""
        if n <= 0:
            raise ValueError("batch size must be positive")
        at = F.floor(F.col("_o0") / n).cast("long")
        lists = self.indexed().df.groupBy(at.alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_o0", "value"))).alias("_l"))
        return Stream(lists.select(F.col("_b").alias("_o0"), F.transform("_l", lambda z: z["value"]).alias("value")), [("_o0", True)])

    def scan(self, fold: str, value: Fn = lambda x: x, init: Any = None) -> Stream:
        """The running ``fold`` (sum, min, max or count), from ``init`` if given; the start itself is not an element."""
        df = running(self.df, self.by(), value(F.col("value")), fold, "_s")
        out = F.col("_s")
        if init is not None:
            out = out + F.lit(init) if fold in ("sum", "count") else getattr(F, {"min": "least", "max": "greatest"}[fold])(out, F.lit(init))
        return self._with(df.select(out.alias("value"), *[c for c, _ in self.order]))

    def scan_with(self, init: Any, f: Callable[[Any, Any], Any], kind: str, merge: Callable[[Any, Any], Any] | None = None) -> Stream:
        """Running fold of any Python function; ``kind`` is the fold's type.

        With ``merge``, which joins two folds each begun at ``init``, the sorted parts
        are folded in parallel and run again from what comes before each. Without it
        each step needs the one before, so the parts go one after the other: a task
        holds a part's rows as a stream and the fold as its only state, and what is
        done of earlier parts is written. Use :meth:`scan` where the fold combines.
        """
        cols = [c for c, _ in self.order]
        parts = laid_out(self.df, self.by())
        order = ", ".join(f"{c} {self.df.schema[c].dataType.simpleString()}" for c in cols)
        out = f"{order}, value {kind}, {PART} int, {AT} long"

        def run(starts: dict[int, Any]):
            def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                part, acc = None, init
                for batch in batches:
                    folds = []
                    for x, p in zip(batch["value"], batch[PART].tolist(), strict=True):
                        if p != part:
                            part, acc = p, starts.get(p, init)
                        acc = f(acc, x)
                        folds.append(acc)
                    yield batch[[*cols, PART, AT]].assign(value=folds)[[*cols, "value", PART, AT]]

            return step

        def folded(rows: DataFrame, starts: dict[int, Any]) -> DataFrame:
            return rows.repartition(PART).sortWithinPartitions(PART, AT).mapInPandas(run(starts), out)

        numbers = [r[PART] for r in parts.select(PART).distinct().orderBy(PART).collect()]  # a row a part
        last = lambda rows: {r[PART]: r["value"] for r in rows.groupBy(PART).agg(F.max_by("value", AT).alias("value")).collect()}
        starts, acc, done = {}, init, []
        if merge is not None:
            totals = last(folded(parts, {}))
            for p in numbers:
                starts[p] = acc
                acc = merge(acc, totals[p])
            done = [folded(parts, starts)]
        for p in numbers if merge is None else []:
            done.append(staged(folded(parts.where(F.col(PART) == p), {p: acc}), "scanned"))
            acc = last(done[-1])[p]
        rows = reduce(DataFrame.unionByName, done) if done else parts.mapInPandas(run({}), out)
        return self._with(rows.select("value", *cols))

    # --- terminals ----------------------------------------------------------

    def collect(self) -> list:
        return [r["value"] for r in self.df.orderBy(*self.by()).select("value").collect()]

    def show(self, n: int = 20) -> Stream:
        """Prints the first n elements and goes on with the same stream."""
        from ..sinks.writers import show

        for x in self.take(n).collect():
            print(show(x))
        return self

    def each(self, f: Callable[[Any], None]) -> None:
        """For side effects, on the executors; the order of partitions is not defined."""
        self.df.select("value").foreachPartition(lambda rows: [f(r["value"]) for r in rows] and None)

    def _one(self, *aggregates: Column) -> Any:
        return self.df.agg(*aggregates).first()

    def count(self) -> int:
        return self._one(F.count(F.lit(1)))[0]

    def sum(self) -> int | float:
        return self._one(F.coalesce(F.sum("value"), F.lit(0)))[0]

    def avg(self) -> float | None:
        return self._one(F.avg("value"))[0]

    def min(self) -> Any:
        return self._one(F.min("value"))[0]

    def max(self) -> Any:
        return self._one(F.max("value"))[0]

    def first(self) -> Any:
        """Null for the empty stream."""
        row = self.df.orderBy(*self.by()).select("value").first()
        return row["value"] if row else None

    def last(self) -> Any:
        back = Stream(self.df, [(c, not up) for c, up in self.order])
        return back.first()

    def single(self) -> dict:
        """A Result: Ok of the only element, else Err."""
        rows = self.df.select("value").limit(2).collect()
        if len(rows) == 1:
            return {"is_ok": True, "ok": rows[0]["value"], "err": None}
        return {"is_ok": False, "ok": None, "err": "expected single element" if rows else "empty stream"}

    def reduce(self, init: Any, f: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column] | None = None, chunk: int = 10_000) -> Any:
        """A left fold.

        A sum of integers, a least or a greatest is one aggregate, whatever the order.
        With ``merge``, which joins two folds each begun at ``init``, lists of ``chunk``
        elements are folded in parallel and the folds merged in order, level by level.
        Without it every step needs the one before: lists of ``chunk`` elements are
        folded one after the other, each from the fold before it.
        """
        start = init if isinstance(init, Column) else F.lit(init)
        plain = self._plain_fold(start, f)
        if plain is not None:
            return plain
        values = lambda c: F.transform(F.array_sort(c), lambda z: z["value"])
        lists = lambda df: df.groupBy(F.floor(F.col("_o0") / chunk).cast("long").alias("_b")).agg(values(F.collect_list(F.struct("_o0", "value"))).alias("xs"))
        numbered_ = self.indexed().df
        first = self.spark.range(1).select(start.alias("value"))
        if merge is None:
            some, kind = staged(lists(numbered_), "lists"), first.schema[0].dataType
            acc = first.first()[0]
            for b in range(some.agg(F.coalesce(F.max("_b"), F.lit(-1))).first()[0] + 1):
                acc = some.where(F.col("_b") == b).select(F.aggregate("xs", F.lit(acc).cast(kind), f)).first()[0]
            return acc
        level = lambda df, g: lists(df).select(F.col("_b").alias("_o0"), F.aggregate("xs", start, g).alias("value"))
        folds = level(numbered_, f)
        while folds.limit(2).count() > 1:
            folds = level(staged(folds, "folds"), merge)
        row = folds.first()
        return row["value"] if row else first.first()[0]

    def _plain_fold(self, start: Column, f: Callable[[Column, Column], Column]) -> Any:
        """The value of a fold that is a sum of integers, a least or a greatest; else null."""
        a, x = F.col("a"), F.col("x")
        form = str(f(a, x))
        exact = isinstance(self.kind, (T.IntegralType, T.DecimalType))
        for fold, shapes, sure in (("sum", (a + x, x + a), exact), ("min", (F.least(a, x), F.least(x, a)), True), ("max", (F.greatest(a, x), F.greatest(x, a)), True)):
            if sure and form in map(str, shapes):
                out = COMBINING[fold]("value")
                whole = start + F.coalesce(out, F.lit(0)) if fold == "sum" else {"min": F.least, "max": F.greatest}[fold](start, out)
                return self._one(whole)[0]
        return None

    def fold(self, name: str, value: Fn = lambda x: x) -> Any:
        """A fold that combines (sum, min, max, count) as one aggregate."""
        return self._one(COMBINING[name](value(F.col("value"))))[0]

    def tee(self, **branches: Callable[[Stream], Any]) -> dict[str, Any]:
        """Every branch sees all elements, computed once. A branch that returns a Column is an aggregate: all those run as one."""
        aggregates = {k: f for k, f in branches.items() if isinstance(f, Column)}
        pipes = {k: f for k, f in branches.items() if k not in aggregates}
        results = {}
        if pipes:
            once = self._with(staged(self.df, "tee"))
            results = {k: f(once) for k, f in pipes.items()}
        if aggregates:
            row = self.df.agg(*[c.alias(k) for k, c in aggregates.items()]).first()
            results |= {k: row[k] for k in aggregates}
        return {k: results[k] for k in branches}

    # --- beyond the pipeline: relations -------------------------------------

    def group_by(self, **keys: Fn):
        """Grouped data over ``value`` with the named keys, for ``agg``."""
        return self.df.groupBy(*[f(F.col("value")).alias(k) for k, f in keys.items()])

    def join(self, other: Stream, on: Callable[[Column, Column], Column], how: str = "inner") -> Stream:
        """Pairs (_1, _2) of elements for which ``on`` holds, in the order of both. An equality in ``on`` is a hash or merge join."""
        sides = [s.df.select(F.col("value").alias(f"_{i}"), *[F.col(c).alias(f"_{i}{c}") for c, _ in s.order]) for i, s in ((1, self), (2, other))]
        both = sides[0].join(sides[1], on(F.col("_1"), F.col("_2")), how)
        order = [(f"_{i}{c}", up) for i, s in ((1, self), (2, other)) for c, up in s.order]
        named = [(f"_o{n}", up) for n, (_, up) in enumerate(order)]
        return Stream(both.select(F.struct("_1", "_2").alias("value"), *[F.col(c).alias(n) for (c, _), (n, _) in zip(order, named, strict=True)]), named)

    def union(self, other: Stream) -> Stream:
        """This stream's elements, then the other's. Orders of like types need no numbering: a branch number comes first."""
        like = [(self.df.schema[c].dataType, up) for c, up in self.order] == [(other.df.schema[c].dataType, up) for c, up in other.order]
        if like and self.order:
            branches = [s.df.select("value", F.lit(i).cast("long").alias("_o0"), *[F.col(c).alias(f"_o{k}") for k, (c, _) in enumerate(s.order, 1)]) for i, s in enumerate((self, other))]
            return Stream(branches[0].unionByName(branches[1]), [("_o0", True), *[(f"_o{k}", up) for k, (_, up) in enumerate(self.order, 1)]])
        a, b = (s.indexed().df.withColumn("_o1", F.col("_o0")).withColumn("_o0", F.lit(i).cast("long")) for i, s in enumerate((self, other)))
        return Stream(a.unionByName(b), [("_o0", True), ("_o1", True)])

