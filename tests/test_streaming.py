import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepipe.streaming import sources, stateful


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(i % 7)) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "id long, k long, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


SCHEMA = "id long, k long, ts timestamp, v double"


def test_windows_equal_the_batch(spark, folder):
    stream = sources.records(spark, folder, SCHEMA, max_files=1)
    got = run(stateful.windowed(stream, "ts", "2 hours", "10 minutes", None, F.sum("v").alias("s"), by=("k",)), "w", "complete")
    batch = spark.read.parquet(folder).groupBy(F.window("ts", "10 minutes"), "k").agg(F.sum("v").alias("s"))
    assert sorted(got.select("k", "s").collect()) == sorted(batch.select("k", "s").collect())


def test_scan_batches_and_distinct(spark, folder):
    stream = sources.records(spark, folder, SCHEMA)
    got = run(stateful.scan(stream, "k", "id", "v", 0.0, lambda a, x: a + x), "s").orderBy("id").collect()
    acc, expected = {}, []
    for i in range(60):
        acc[i % 3] = acc.get(i % 3, 0.0) + i % 7
        expected.append(acc[i % 3])
    assert [r["v"] for r in got] == expected
    lists = run(stateful.batches(stream, 6, "k", "id", "v"), "b").collect()
    assert len(lists) == 9 and all(len(r["values"]) == 6 for r in lists)
    assert run(stateful.distinct(stream, ["k"], "ts", "1 day"), "d").count() == 3


def test_last_batches_are_the_rows_that_fill_no_list(spark, folder, tmp_path):
    stream = sources.records(spark, folder, SCHEMA, max_files=1).where("k < 2 or id < 6")
    query = stateful.batches(stream, 6, "k", "id", "v").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    lists = spark.read.parquet(str(tmp_path / "out")).unionByName(stateful.last_batches(spark, str(tmp_path / "state"))).collect()
    assert sorted((r["k"], r["batch"], len(r["values"])) for r in lists) == [(k, b, 6 if b < 3 else 2) for k in (0, 1) for b in range(4)] + [(2, 0, 2)]


def test_a_hot_key_is_spread(spark, folder, tmp_path):
    # A tenth of the rows has keys of its own or none; three micro-batches of one file.
    stream = sources.records(spark, folder, SCHEMA, max_files=1).withColumn("k", F.when(F.col("id") % 10 == 7, F.col("id") % 3).when(F.col("id") % 20 != 9, F.lit(1)))
    rows = sorted((r.id, -1 if r.k is None else r.k, r.v) for r in spark.read.schema(SCHEMA).parquet(folder).withColumn("k", F.when(F.col("id") % 10 == 7, F.col("id") % 3).when(F.col("id") % 20 != 9, F.lit(1))).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, writer in (
            ("s", stateful.scan_to(stream, "k", "id", "v", 0.0, lambda a, x: a + x, lambda a, b: a + b, f"file://{tmp_path}/s")),
            ("b", stateful.batches_to(stream, 6, "k", "id", "v", f"file://{tmp_path}/b")),
        ):
            run = writer.trigger(availableNow=True).start()
            run.awaitTermination()
            assert (name, run.lastProgress["batchId"]) == (name, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = stateful.results(spark, f"file://{tmp_path}/s")
    files = got.where("k = 1").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 3  # several tasks in each of three micro-batches
    folds, lists = {}, {}
    for i, k, v in rows:
        folds[k] = [*folds.get(k, []), (i, v + (folds[k][-1][1] if k in folds else 0.0))]
        lists.setdefault(k, []).append(v)
    assert sorted((-1 if r.k is None else r.k, r.id, r.v) for r in got.collect()) == sorted((k, *x) for k, xs in folds.items() for x in xs)
    got = stateful.results(spark, f"file://{tmp_path}/b").unionByName(stateful.unfilled(spark, f"file://{tmp_path}/b", "k", 2)).collect()
    assert sorted((-1 if r.k is None else r.k, r.batch, r["values"]) for r in got) == sorted((k, i // 6, v[i : i + 6]) for k, v in lists.items() for i in range(0, len(v), 6))


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.jsonl").write_text('{"a": 1}\n\nbad\n')
    got = run(sources.jsonl(spark, str(tmp_path / "t"), "a int"), "j").select("value.is_ok").collect()
    assert sorted(r["is_ok"] for r in got) == [False, True]
    assert sources.tick(spark, 100).isStreaming and sources.tick(spark, 3000).columns == ["value", "timestamp"]
    with pytest.raises(ValueError):
        sources.tick(spark, 0)


@pytest.mark.parametrize("interval", [700, 1500, 40])
def test_tick_has_its_interval(spark, interval):
    df = sources.tick(spark, interval)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert df.columns == ["value", "timestamp"] and "rate" in plan.lower()
    if interval == 40:
        q = df.writeStream.format("memory").queryName("ticks").trigger(processingTime="200 milliseconds").start()
        import time

        time.sleep(4)
        q.processAllAvailable()
        q.stop()
        rows = spark.table("ticks").orderBy("value").collect()
        gaps = [(b.timestamp - a.timestamp).total_seconds() for a, b in zip(rows, rows[1:])]
        assert [r.value for r in rows] == list(range(len(rows))) and len(rows) > 20 and abs(sum(gaps) / len(gaps) - 0.04) < 0.002
    with pytest.raises(ValueError, match="positive"):
        sources.tick(spark, 0)
