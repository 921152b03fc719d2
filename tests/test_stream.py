"""Golden answers of the ordered pipeline, on tiny streams."""

import pytest
from pyspark.sql import functions as F

from tidepipe.functions import values as V
from tidepipe.operators.jobs import join, spawn, try_join
from tidepipe.operators.stream import Stream
from tidepipe.sources.readers import env, iterate, range_, repeat


def test_generators(spark):
    assert range_(spark, 1, 6).collect() == [1, 2, 3, 4, 5]
    assert range_(spark, 5, 0, -2).collect() == [5, 3, 1]
    assert repeat(spark, 42, 3).collect() == [42, 42, 42]
    assert iterate(spark, 1, lambda x: x * 2, 5).collect() == [1, 2, 4, 8, 16]
    with pytest.raises(ValueError):
        range_(spark, 1, 2, 0)


def test_transforms(spark):
    one = range_(spark, 1, 6)
    assert one.map(lambda x: x * 10).collect() == [10, 20, 30, 40, 50]
    assert range_(spark, 1, 11).filter(lambda x: x > 7).collect() == [8, 9, 10]
    assert one.filter_map(lambda x: F.when(x > 3, x * 10)).collect() == [40, 50]
    assert one.filter_map(lambda x: F.struct((x > 3).alias("is_some"), (x * 10).alias("value"))).collect() == [40, 50]
    assert range_(spark, 1, 4).flat_map(lambda x: F.array_repeat(x, 2)).collect() == [1, 1, 2, 2, 3, 3]
    assert range_(spark, 1, 4).map(lambda x: F.array(x, x * 10)).flatten().collect() == [1, 10, 2, 20, 3, 30]
    assert range_(spark, 1, 4).flatten().collect() == [1, 2, 3]
    assert range_(spark, 1, 11).take(3).collect() == [1, 2, 3]
    assert range_(spark, 1, 11).drop(7).collect() == [8, 9, 10]
    assert one.take(0).collect() == [] and one.take(-1).collect() == [] and one.drop(0).count() == 5


def test_ordered(spark):
    assert range_(spark, 1, 6).scan("sum").collect() == [1, 3, 6, 10, 15]
    assert range_(spark, 1, 6).scan("sum", init=100).collect() == [101, 103, 106, 110, 115]
    assert range_(spark, 1, 6).scan_with(0, lambda a, x: a * 2 + x, "long").collect() == [1, 4, 11, 26, 57]
    assert range_(spark, 1, 4).flat_map(lambda x: F.array_repeat(x, 2)).distinct().collect() == [1, 2, 3]
    assert [tuple(p) for p in range_(spark, 1, 4).zip(range_(spark, 10, 15)).collect()] == [(1, 10), (2, 11), (3, 12)]
    assert range_(spark, 1, 8).batch(3).collect() == [[1, 2, 3], [4, 5, 6], [7]]
    with pytest.raises(ValueError):
        range_(spark, 3).batch(0)


def test_sort_is_stable_and_descending_reverses_ties(spark):
    s = Stream.from_list(spark, [("a", 1), ("b", 2), ("c", 1)], "struct<n:string,k:int>")
    assert [x["n"] for x in s.sort_by(lambda x: x["k"]).collect()] == ["a", "c", "b"]
    assert [x["n"] for x in s.sort_by(lambda x: x["k"], descending=True).collect()] == ["b", "c", "a"]


def test_terminals(spark):
    one = range_(spark, 1, 6)
    assert (one.sum(), one.count(), one.first(), one.last(), one.min(), one.max(), one.avg()) == (15, 5, 1, 5, 1, 5, 3.0)
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    assert one.reduce(zero, add) == 15 == one.reduce(zero, add, merge=add, chunk=2)
    none = range_(spark, 1, 1)
    assert (none.sum(), none.count(), none.first(), none.last(), none.avg()) == (0, 0, None, None, None)
    assert none.reduce(zero, add, merge=add) == 0
    assert none.single()["err"] == "empty stream" and one.single()["err"] == "expected single element" and one.take(1).single()["ok"] == 1


def test_results(spark):
    s = range_(spark, 1, 6).map(lambda x: F.struct((x % 2 == 1).alias("is_ok"), F.when(x % 2 == 1, x).alias("ok"), F.when(x % 2 == 0, x).alias("err")))
    parts = s.partition_result()
    assert parts["ok"].collect() == [1, 3, 5] and parts["err"].collect() == [2, 4]
    assert s.filter_ok().collect() == [1, 3, 5] and s.filter_err().collect() == [2, 4]
    assert range_(spark, 3).partition_result()["err"].collect() == []
    seen, watch = s.tap_err("errors")
    assert seen.count() == 5 and watch.get["errors"] == 2


def test_par_map_result(spark):
    def f(x):
        if x == 2:
            raise ValueError("bad")
        return x * 100

    got = range_(spark, 1, 4).par_map_result(f, "long", 2).collect()
    assert [(r["is_ok"], r["ok"], r["err"]) for r in got] == [(True, 100, None), (False, None, "bad"), (True, 300, None)]
    assert range_(spark, 1, 11).par_map(lambda x: x * 2, 3).filter(lambda x: x > 10).collect() == [12, 14, 16, 18, 20]


def test_tee(spark):
    got = range_(spark, 1, 4).tee(doubled=lambda s: s.map(lambda x: x * 2).collect(), total=F.sum("value"))
    assert got == {"doubled": [2, 4, 6], "total": 6}


def test_nested_records(spark):
    schema = "struct<desc:string,value:struct<output:struct<msgs:array<struct<speed:int>>>>>"
    s = Stream.from_list(spark, [("a", ((([(10,)]),),)), ("b", None), ("c", ((([(30,)]),),))], schema)
    speeds = s.filter_map(lambda x: V.field(x, "value", "output", "msgs")).flatten().map(lambda x: x["speed"])
    assert speeds.collect() == [10, 30] and speeds.avg() == 20.0


def test_order_is_not_paid_for_where_it_is_not_seen(spark):
    plan = range_(spark, 100).map(lambda x: x + 1).filter(lambda x: x > 3).df._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Sort" not in plan.split("Physical Plan")[-1]


def test_properties(spark):
    s = range_(spark, 50)
    for n in (0, 1, 7, 50, 99):
        assert s.take(n).collect() + s.drop(n).collect() == s.collect()
    assert s.batch(7).flatten().collect() == s.collect()
    assert s.scan("sum").last() == s.sum()
    assert s.union(range_(spark, 3)).collect() == [*range(50), 0, 1, 2]


def test_jobs_and_env(spark):
    assert join(spawn(lambda: range_(spark, 5).count()))["ok"] == 5
    failed = join(spawn(lambda: 1 // 0))
    assert not failed["is_ok"] and "zero" in failed["err"]
    job = spawn(lambda: 7)
    job.result()
    assert try_join(job)["ok"] == 7
    assert env("TIDEPIPE_NO_SUCH")["err"] == "undefined environment variable" and env("TIDEPIPE_NO_SUCH", "d") == "d"


def test_filters_and_columns_reach_the_scan(spark):
    events = Stream.of(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "event_id")
    got = events.filter(lambda e: (e["event_type"] == "click") & (e["value"] > 7)).map(lambda e: e["value"] * 2)
    plan = got.records()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "GreaterThan(value,7.0)" in plan and "props" not in plan.split("ReadSchema")[1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_drop_and_page_do_not_gather_all_rows(spark):
    s = Stream.of(spark.range(1000).repartition(5), "id")
    for df in (s.drop(10).df, s.drop(10).take(5).df):
        assert "SinglePartition" not in plan_of(df).replace("TakeOrderedAndProject", "")
    assert [r["id"] for r in s.drop(10).take(5).collect()] == list(range(10, 15))
    assert [r["id"] for r in s.drop(10).drop(980).collect()] == list(range(990, 1000))
    assert s.drop(2000).collect() == [] and s.drop(0) is s and s.drop(3).count() == 997
    assert [r["id"] for r in s.drop(995).sort_by(lambda r: r["id"], descending=True).take(2).collect()] == [999, 998]


def test_folds_of_any_kind(spark):
    s = Stream.of(spark.range(100).repartition(7), "id").map(lambda r: r["id"])
    assert s.scan_with(1, lambda a, x: (a * 3 + x) % 1000, "long").collect() == list(accumulate_with(1, range(100)))
    assert s.scan_with("", lambda a, x: a + str(x), "string", merge=lambda a, b: a + b).last() == "".join(map(str, range(100)))
    assert s.reduce(F.lit(1).cast("long"), lambda a, x: (a * 3 + x) % 1000, chunk=9) == list(accumulate_with(1, range(100)))[-1]
    assert s.reduce(F.lit(5).cast("long"), lambda a, x: x + a) == 5 + 4950 and s.reduce(F.lit(-3).cast("long"), F.greatest) == 99
    empty = s.filter(lambda x: x < 0)
    assert empty.scan_with(0, lambda a, x: a + x, "long").collect() == [] and empty.reduce(F.lit(7).cast("long"), lambda a, x: a * x) == 7


def accumulate_with(acc, xs):
    for x in xs:
        acc = (acc * 3 + x) % 1000
        yield acc


def test_joins_of_streams(spark):
    a, b = Stream.from_list(spark, [1, 2, 3], "int"), Stream.from_list(spark, [2, 3], "int")
    assert [(x["_1"], x["_2"]) for x in a.join(b, lambda x, y: x < y).collect()] == [(1, 2), (1, 3), (2, 3)]
    assert a.union(b).collect() == [1, 2, 3, 2, 3] and "Exchange" not in plan_of(a.union(b).df)
