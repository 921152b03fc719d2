"""A query for each operator over the driver's tables, with the SQL that DuckDB runs beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import json as J
from .functions import lists as L
from .functions import maps as M
from .functions import results as R
from .functions import strings as S
from .functions import values as V
from .operators import jobs
from .operators.stream import Stream
from .plans.staging import shared_dir
from .sources import readers
from .sinks import writers
from .sinks.writers import sink
from .streaming import sources as streams
from .streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> Stream:
    return Stream.of(table(spark, d, "events"), "event_id")


def orders(spark: SparkSession, d: str) -> Stream:
    return Stream.of(table(spark, d, "orders"), "o_orderkey")


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


# --- transforms -----------------------------------------------------------------


@query("SELECT event_id, user_id, round(value * 10, 2) AS v10 FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id DESC LIMIT 20")
def q_top_events(spark, d):
    top = events(spark, d).filter(lambda e: e["event_type"] == "purchase").sort_by(lambda e: e["value"], descending=True).take(20)
    return top.map(lambda e: V.record(event_id=e["event_id"], user_id=e["user_id"], v10=F.round(e["value"] * 10, 2))).records()


@query("SELECT event_id, round(value * 10, 2) AS v10 FROM events WHERE event_type = 'click' AND value > 7")
def q_filter_map(spark, d):
    kept = events(spark, d).filter(lambda e: (e["event_type"] == "click") & (e["value"] > 7))
    return kept.map(lambda e: V.record(event_id=e["event_id"], v10=F.round(e["value"] * 10, 2))).records()


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS value FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def q_filter_map_opt(spark, d):
    k = lambda e: J.field(e["props"], "$.k").cast("long")
    return events(spark, d).filter_map(lambda e: F.when(k(e) > 50, k(e) * 2)).records()


@query("SELECT o_orderkey * 10 + g AS value FROM orders, generate_series(0, 2) AS t(g)")
def q_flat_map(spark, d):
    return orders(spark, d).flat_map(lambda o: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda g: o["o_orderkey"] * 10 + g)).records()


@query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos, unnest(embedding) AS x FROM embeddings")
def q_flatten(spark, d):
    vecs = Stream.of(table(spark, d, "embeddings"), "vec_id")
    rows = vecs.map(lambda v: F.transform(v["embedding"], lambda x, i: V.record(vec_id=v["vec_id"], pos=i.cast("long"), x=x)))
    return rows.flatten().records()


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 100")
def q_take(spark, d):
    return events(spark, d).take(100).records().select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY event_id OFFSET 500")
def q_drop(spark, d):
    return events(spark, d).drop(500).records().select("event_id", "value")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def q_page(spark, d):
    return orders(spark, d).drop(50).take(25).records().select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
def q_topk(spark, d):
    return orders(spark, d).sort_by(lambda o: o["o_totalprice"], descending=True).take(20).records().select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT event_type, user_id FROM events")
def q_distinct(spark, d):
    return events(spark, d).map(lambda e: V.record(event_type=e["event_type"], user_id=e["user_id"])).distinct().records()


@query("SELECT min(event_id) AS event_id, event_type FROM events GROUP BY event_type")
def q_distinct_first(spark, d):
    first = events(spark, d).map(lambda e: e["event_type"]).distinct()
    return first.df.select(F.col("_o0").alias("event_id"), F.col("value").alias("event_type"))


@query("""
    WITH a AS (SELECT user_id, row_number() OVER (ORDER BY event_id) AS n FROM events),
         b AS (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
    SELECT n - 1 AS n, user_id AS a, o_custkey AS b FROM a JOIN b USING (n)
""")
def q_zip(spark, d):
    pairs = events(spark, d).map(lambda e: e["user_id"]).zip(orders(spark, d).map(lambda o: o["o_custkey"]))
    return pairs.df.select(F.col("_o0").alias("n"), F.col("value._1").alias("a"), F.col("value._2").alias("b"))


@query("""
    WITH r AS (SELECT user_id, event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events)
    SELECT n // 64 AS batch, count(*) AS size, list(user_id ORDER BY event_id)[1] AS head, CAST(sum(user_id) AS BIGINT) AS total FROM r GROUP BY 1
""")
def q_batch(spark, d):
    lists = events(spark, d).map(lambda e: e["user_id"]).batch(64)
    total = F.aggregate("value", F.lit(0).cast("long"), lambda a, x: a + x)
    return lists.df.select(F.col("_o0").alias("batch"), F.size("value").cast("long").alias("size"), F.get("value", F.lit(0)).alias("head"), total.alias("total"))


@query("SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS total FROM events")
def q_scan_sum(spark, d):
    return events(spark, d).scan("sum", lambda e: e["user_id"]).df.select(F.col("_o0").alias("event_id"), F.col("value").alias("total"))


@query("SELECT event_id, max(value) OVER (ORDER BY event_id) AS top FROM events")
def q_scan_max(spark, d):
    return events(spark, d).scan("max", lambda e: e["value"]).df.select(F.col("_o0").alias("event_id"), F.col("value").alias("top"))


@query("SELECT event_id, 100 + count(*) OVER (ORDER BY event_id) AS n FROM events")
def q_scan_count(spark, d):
    return events(spark, d).scan("count", lambda e: e["value"], init=100).df.select(F.col("_o0").alias("event_id"), F.col("value").alias("n"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS BIGINT) AS place FROM orders")
def q_sort_by(spark, d):
    ranked = orders(spark, d).sort_by(lambda o: o["o_orderpriority"]).indexed()
    return ranked.df.select(F.col("value.o_orderkey").alias("o_orderkey"), F.col("_o0").alias("place"))


def _props(spark, d) -> Stream:
    """Every seventh event's properties are broken."""
    return events(spark, d).map(lambda e: J.decode(F.when(e["event_id"] % 7 == 0, F.lit("bad")).otherwise(e["props"]), "k int"))


@query("SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 7 <> 0")
def q_partition_ok(spark, d):
    return _props(spark, d).partition_result()["ok"].records()


@query("SELECT 'invalid JSON' AS message, 0 AS position FROM events WHERE event_id % 7 = 0")
def q_partition_err(spark, d):
    return _props(spark, d).partition_result()["err"].records()


@query("SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 7 <> 0")
def q_filter_ok(spark, d):
    return _props(spark, d).filter_ok().records()


@query("SELECT count(*) AS n, min('invalid JSON') AS message FROM events WHERE event_id % 7 = 0")
def q_filter_err(spark, d):
    return _props(spark, d).filter_err().df.agg(F.count(F.lit(1)).alias("n"), F.min("value.message").alias("message"))


@query("SELECT event_id * 2 AS value FROM events WHERE event_id * 2 > 100")
def q_par_map(spark, d):
    return events(spark, d).par_map(lambda e: e["event_id"] * 2, 4).filter(lambda x: x > 100).records()


@query("""
    SELECT event_id % 5 <> 0 AS is_ok, CASE WHEN event_id % 5 <> 0 THEN 100 // (event_id % 5) END AS ok,
           CASE WHEN event_id % 5 = 0 THEN 'integer division or modulo by zero' END AS err FROM events
""")
def q_par_map_result(spark, d):
    tried = events(spark, d).map(lambda e: e["event_id"] % 5).par_map_result(lambda x: 100 // x, "long")
    err = F.when(F.col("err").contains("zero"), F.lit("integer division or modulo by zero"))
    return tried.records().withColumn("err", err)


def _seen(spark, tapped) -> DataFrame:
    """What a tap has seen when the stream has been read."""
    stream, seen = tapped
    n = stream.df.agg(F.count("value").alias("n")).first()["n"]
    return one_row(spark, passed=n, **seen.get)


@query("SELECT count(*) AS passed, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events")
def q_tap(spark, d):
    return _seen(spark, events(spark, d).tap("seen", F.count(F.lit(1)).alias("n"), F.sum("value.user_id").alias("users")))


@query("SELECT count(*) AS passed, CAST(sum(user_id) AS BIGINT) AS total FROM events")
def q_tap_each(spark, d):
    total = spark.sparkContext.accumulator(0)
    stream = events(spark, d).map(lambda e: e["user_id"]).tap_each(lambda x: total.add(x))
    return one_row(spark, passed=stream.count(), total=F.lit(total.value).cast("long"))


@query("SELECT count(*) AS passed, count(*) FILTER (event_id % 7 = 0) AS errors FROM events")
def q_tap_err(spark, d):
    return _seen(spark, _props(spark, d).tap_err("failed")).select("passed", "errors")


@query("SELECT event_id, user_id FROM events")
def q_buffer(spark, d):
    return events(spark, d).buffer(16).records().select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events")
def q_throttle(spark, d):
    return events(spark, d).throttle(1000, "per_second").records().select("event_id", "user_id")


@query("SELECT event_id * 3 AS value FROM events")
def q_par_map_unordered(spark, d):
    return events(spark, d).par_map_unordered(lambda e: e["event_id"] * 3, 4).records()


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS total, count(*) AS n FROM orders")
def q_each(spark, d):
    total, n = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def note(x: int) -> None:
        total.add(x)
        n.add(1)

    orders(spark, d).map(lambda o: o["o_custkey"]).each(note)
    return one_row(spark, total=F.lit(total.value).cast("long"), n=F.lit(n.value).cast("long"))


@query("SELECT event_id, CAST(sum(user_id * 2) OVER (ORDER BY event_id) AS BIGINT) AS total FROM events")
def q_scan_with(spark, d):
    folds = events(spark, d).map(lambda e: e["user_id"] * 2).scan_with(0, lambda a, x: a + x, "long", merge=lambda a, b: a + b)
    return folds.df.select(F.col("_o0").alias("event_id"), F.col("value").alias("total"))


@query("SELECT n_nationkey, string_agg(n_name, '') OVER (ORDER BY n_nationkey) AS names FROM nation")
def q_scan_with_steps(spark, d):
    names = Stream.of(table(spark, d, "nation"), "n_nationkey").map(lambda n: n["n_name"]).scan_with("", lambda a, x: a + x, "string")
    return names.df.select(F.col("_o0").alias("n_nationkey"), F.col("value").alias("names"))


@query("SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS names FROM nation")
def q_reduce_steps(spark, d):
    return one_row(spark, names=Stream.of(table(spark, d, "nation"), "n_nationkey").map(lambda n: n["n_name"]).reduce("", V.concat, chunk=4))


@query("SELECT min(l_shipdate) AS first, max(l_quantity) AS most FROM lineitem")
def q_reduce_min_max(spark, d):
    lines = table(spark, d, "lineitem")
    first = Stream.of(lines, *lines.columns).map(lambda x: x["l_shipdate"]).reduce(F.lit("2200-01-01").cast("timestamp_ntz"), F.least)
    most = Stream.of(lines, *lines.columns).map(lambda x: x["l_quantity"]).reduce(F.lit(0.0), F.greatest)
    return one_row(spark, first=first, most=most)


# --- terminals ------------------------------------------------------------------


@query("SELECT count(*) AS n FROM events WHERE value > 5")
def q_count(spark, d):
    return one_row(spark, n=events(spark, d).filter(lambda e: e["value"] > 5).count())


@query("SELECT CAST(sum(user_id) AS BIGINT) AS total, CAST(0 AS BIGINT) AS none FROM events")
def q_sum(spark, d):
    ids = events(spark, d).map(lambda e: e["user_id"])
    return one_row(spark, total=ids.sum(), none=ids.filter(lambda x: x < 0).sum()).select(F.col("total").cast("long"), F.col("none").cast("long"))


@query("SELECT round(avg(user_id), 6) AS mean FROM events")
def q_avg(spark, d):
    return one_row(spark, mean=round(events(spark, d).map(lambda e: e["user_id"]).avg(), 6))


@query("SELECT min(value) AS low, max(value) AS high FROM events")
def q_min_max(spark, d):
    values = events(spark, d).map(lambda e: e["value"])
    return one_row(spark, low=values.min(), high=values.max())


@query("SELECT CAST(sum(l_linenumber * 2) AS BIGINT) AS total FROM lineitem")
def q_reduce(spark, d):
    lines = table(spark, d, "lineitem")
    numbers = Stream.of(lines, *lines.columns).map(lambda x: x["l_linenumber"].cast("long") * 2)
    return one_row(spark, total=numbers.reduce(F.lit(0).cast("long"), lambda a, x: a + x, merge=lambda a, b: a + b))


@query("SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS names FROM nation")
def q_reduce_ordered(spark, d):
    nations = Stream.of(table(spark, d, "nation"), "n_nationkey").map(lambda n: n["n_name"])
    return one_row(spark, names=nations.reduce("", V.concat, merge=V.concat, chunk=4))


@query("SELECT arg_min(user_id, event_id) AS first, arg_max(user_id, event_id) AS last FROM events")
def q_first_last(spark, d):
    ids = events(spark, d).map(lambda e: e["user_id"])
    return one_row(spark, first=ids.first(), last=ids.last())


@query("SELECT r_regionkey AS ok, 'expected single element' AS many, 'empty stream' AS none FROM region WHERE r_name = 'ASIA'")
def q_single(spark, d):
    regions = Stream.of(table(spark, d, "region"), "r_regionkey")
    asia = regions.filter(lambda r: r["r_name"] == "ASIA").map(lambda r: r["r_regionkey"]).single()
    return one_row(spark, ok=asia["ok"], many=regions.single()["err"], none=regions.filter(lambda r: r["r_regionkey"] < 0).single()["err"])


@query("SELECT count(*) AS n, max(value) AS top, CAST(sum(user_id) AS BIGINT) AS users FROM events")
def q_tee(spark, d):
    got = events(spark, d).tee(n=F.count(F.lit(1)), top=F.max("value.value"), users=F.sum("value.user_id"))
    return one_row(spark, **got)


@query("SELECT list(n_name ORDER BY n_nationkey) AS names, CAST(count(*) AS BIGINT) AS n FROM nation")
def q_collect(spark, d):
    got = Stream.of(table(spark, d, "nation"), "n_nationkey").map(lambda n: n["n_name"]).collect()
    return spark.createDataFrame([(got, len(got))], "names array<string>, n long")


# --- scalars --------------------------------------------------------------------


@query("""
    SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 100 THEN 'big' WHEN event_type = 'purchase' THEN 'small'
        WHEN event_type = 'error' THEN 'bad' ELSE 'other' END AS label FROM events
""")
def q_match(spark, d):
    label = lambda e: V.match(e["event_type"]).arm("purchase", "big", when=lambda _: e["value"] > 100).arm("purchase", "small").arm("error", "bad").otherwise("other")
    return events(spark, d).map(lambda e: V.record(event_id=e["event_id"], label=label(e))).records()


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE NULL END AS parity FROM events")
def q_if(spark, d):
    return events(spark, d).map(lambda e: V.record(event_id=e["event_id"], parity=V.if_else(e["user_id"] % 2 == 0, "even"))).records()


@query("SELECT event_id, (user_id - 500) // 7 AS quotient, (user_id - 500) % 7 AS rest, -user_id AS negative, user_id * 3 + 1 AS sum3, value / 4 AS quarter FROM events")
def q_arith(spark, d):
    u = lambda e: e["user_id"]
    f = lambda e: V.record(event_id=e["event_id"], quotient=V.int_div(u(e) - 500, F.lit(7)), rest=(u(e) - 500) % 7, negative=-u(e), sum3=u(e) * 3 + 1, quarter=e["value"] / 4)
    return events(spark, d).map(f).records()


@query("SELECT event_id, event_type = 'click' AS same, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END IS NOT DISTINCT FROM NULL AS nil, value > 5 AND NOT (user_id < 10) OR event_type = 'view' AS logic FROM events")
def q_logic(spark, d):
    nil = lambda e: F.when(e["user_id"] % 3 != 0, e["user_id"])
    f = lambda e: V.record(event_id=e["event_id"], same=V.equal(e["event_type"], "click"), nil=V.equal(nil(e), None), logic=(e["value"] > 5) & ~(e["user_id"] < 10) | (e["event_type"] == "view"))
    return events(spark, d).map(f).records()


@query("SELECT p_partkey, string_split(p_name, ' ') AS pieces, len(string_split(p_name, ' ')) AS n, list_aggregate(string_split(p_name, ' '), 'string_agg', '-') AS joined FROM part")
def q_string_split_join(spark, d):
    parts = Stream.of(table(spark, d, "part"), "p_partkey")
    pieces = lambda p: S.split(p["p_name"], " ")
    return parts.map(lambda p: V.record(p_partkey=p["p_partkey"], pieces=pieces(p), n=F.size(pieces(p)).cast("long"), joined=S.join(pieces(p), "-"))).records()


@query(r"SELECT n_nationkey, trim(E' \t' || n_name || E'\r\n ', E' \t\n\r') AS trimmed FROM nation")
def q_string_trim(spark, d):
    padded = lambda n: F.concat(F.lit(" \t"), n["n_name"], F.lit("\r\n "))
    return Stream.of(table(spark, d, "nation"), "n_nationkey").map(lambda n: V.record(n_nationkey=n["n_nationkey"], trimmed=S.trim(padded(n)))).records()


@query("SELECT c_custkey, contains(c_mktsegment, 'BUILD') AS has, starts_with(c_name, 'Cust') AS starts, ends_with(c_name, '1') AS ends, replace(c_mktsegment, 'I', 'ii') AS replaced FROM customer")
def q_string_search(spark, d):
    f = lambda c: V.record(c_custkey=c["c_custkey"], has=S.contains(c["c_mktsegment"], "BUILD"), starts=S.starts_with(c["c_name"], "Cust"), ends=S.ends_with(c["c_name"], "1"), replaced=S.replace(c["c_mktsegment"], "I", "ii"))
    return Stream.of(table(spark, d, "customer"), "c_custkey").map(f).records()


@query("SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS upper, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower FROM documents")
def q_string_case_length(spark, d):
    f = lambda x: V.record(doc_id=x["doc_id"], bytes=S.length(x["text"]), upper=S.to_upper(x["text"]), lower=S.to_lower(x["text"]))
    return Stream.of(table(spark, d, "documents"), "doc_id").map(f).records()


@query("""
    SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'axis ' || o_orderkey % 3 WHEN o_orderkey % 3 = 0 THEN 'axis ' || o_custkey % 5
        WHEN o_custkey % 5 > o_orderkey % 3 THEN 'above' ELSE 'sum ' || (o_custkey % 5 + o_orderkey % 3) END AS place,
        o_custkey % 7 + len(list_filter([o_custkey % 2, o_custkey % 3], lambda x: x > 0)) AS ends FROM orders
""")
def q_match_bind(spark, d):
    def f(o):
        point = L.tuple_of(o["o_custkey"] % 5, o["o_orderkey"] % 3)
        say = lambda word: lambda b: F.concat(F.lit(word), (b.x if hasattr(b, "x") else b.y).cast("string"))
        place = (
            V.match(point)
            .arm((0, V.Bind("y")), say("axis "))
            .arm((V.Bind("x"), 0), say("axis "))
            .arm((V.Bind("x"), V.Bind("y")), "above", when=lambda b: b.x > b.y)
            .arm((V.Bind("x"), V.Bind("y")), lambda b: F.concat(F.lit("sum "), (b.x + b.y).cast("string")))
            .end()
        )
        some = F.filter(F.array(o["o_custkey"] % 2, o["o_custkey"] % 3), lambda x: x > 0)
        xs = F.concat(F.array(o["o_custkey"] % 7), some)
        ends = V.match(V.record(list=xs)).arm({"list": [V.Bind("head"), V.Rest("more")]}, lambda b: b.head + F.size(b.more)).end()
        return V.record(o_orderkey=o["o_orderkey"], place=place, ends=ends)

    return orders(spark, d).map(f).records()


@query("SELECT event_id, lower(typeof(user_id)) AS type, CAST(value AS VARCHAR) AS number, '[' || user_id || ', nil, ' || CAST(value AS VARCHAR) || ']' AS list, '{a: ' || event_type || ', b: (' || user_id || ', true)}' AS record FROM events")
def q_str(spark, d):
    def f(e):
        xs, r = F.array(e["user_id"].cast("string"), F.lit(None).cast("string"), V.to_text(e["value"], "double")), V.record(a=e["event_type"], b=L.tuple_of(e["user_id"], F.lit(True)))
        return V.record(event_id=e["event_id"], type=V.type_of(e["user_id"]), number=V.to_text(e["value"], "double"), list=V.to_text(xs, "array<string>"), record=V.to_text(r, "struct<a:string,b:struct<_1:bigint,_2:boolean>>"))

    return events(spark, d).map(f).records()


@query("SELECT count(*) AS n FROM events WHERE user_id >= 0")
def q_check(spark, d):
    return one_row(spark, n=events(spark, d).filter(lambda e: V.check(e["user_id"] >= 0).isNull()).count())


@query("SELECT n_nationkey, n_name AS first, n_regionkey AS second, NULL AS third, n_nationkey + n_regionkey AS sum FROM nation")
def q_tuples(spark, d):
    def f(n):
        t = L.tuple_of(n["n_name"], n["n_regionkey"])
        return V.record(n_nationkey=n["n_nationkey"], first=L.tuple_get(t, 0, 2), second=L.tuple_get(t, 1, 2), third=L.tuple_get(t, 2, 2).cast("int"), sum=n["n_nationkey"] + t["_2"])

    return Stream.of(table(spark, d, "nation"), "n_nationkey").map(f).records()


# --- lists, maps, results, JSON ---------------------------------------------------


@query("""
    SELECT vec_id, embedding[3] AS third, embedding[65] AS beyond, len(embedding) AS n, list_transform(embedding, lambda x: x * 2) AS doubled,
           list_filter(embedding, lambda x: x > 0.2) AS large, list_reverse(embedding) AS back, list_sort(embedding) AS sorted, list_append(embedding, label) AS more
    FROM embeddings
""")
def q_list_basic(spark, d):
    def f(v):
        xs = v["embedding"]
        return V.record(
            vec_id=v["vec_id"], third=L.get(xs, 2), beyond=L.get(xs, 64), n=L.length(xs).cast("long"), doubled=L.map_(xs, lambda x: (x * 2).cast("float")),
            large=L.filter_(xs, lambda x: x > 0.2), back=L.reverse(xs), sorted=L.sort(xs), more=L.append(xs, v["label"].cast("float")),
        )

    return Stream.of(table(spark, d, "embeddings"), "vec_id").map(f).records()


@query("""
    WITH t AS (SELECT o_orderkey, [o_custkey % 7, o_custkey % 5, o_custkey % 3] AS xs FROM orders)
    SELECT o_orderkey, xs[1] + xs[2] + xs[3] AS total, list_contains(xs, 2) AS has, [xs[1], 99, xs[3]] AS changed,
           [[xs[1], xs[2]], [xs[2], xs[3]]] AS pairs, flatten([xs, [7]]) AS flat, list_filter(xs, lambda x: x > 2) AS some, (xs[1] + xs[2] + xs[3]) / 3 AS mean
    FROM t
""")
def q_list_more(spark, d):
    def f(o):
        xs = F.array(*[o["o_custkey"] % m for m in (7, 5, 3)])
        pairs = F.transform(L.zip_(xs, F.slice(xs, 2, 2)), lambda p: F.array(p["_1"], p["_2"]))
        return V.record(
            o_orderkey=o["o_orderkey"], total=L.reduce(xs, F.lit(0).cast("long"), lambda a, x: a + x), has=L.contains(xs, F.lit(2).cast("long")), changed=L.set_at(xs, 1, F.lit(99).cast("long")),
            pairs=pairs, flat=L.flatten(F.array(xs, F.array(F.lit(7).cast("long")))), some=L.filter_map(xs, lambda x: F.when(x > 2, x)), mean=L.avg(xs),
        )

    return orders(spark, d).map(f).records()


@query("SELECT n_nationkey, list_sort([n_nationkey % 3, n_nationkey % 4, 1]) AS ordered FROM nation")
def q_list_sort_by(spark, d):
    f = lambda n: V.record(n_nationkey=n["n_nationkey"], ordered=L.reverse(L.sort_by(F.array(n["n_nationkey"] % 3, n["n_nationkey"] % 4, F.lit(1)), lambda x: -x)))
    return Stream.of(table(spark, d, "nation"), "n_nationkey").map(f).records()


@query("""
    SELECT n_nationkey, n_name AS name, CAST(NULL AS VARCHAR) AS missing, ['key', 'name', 'region'] AS keys, [CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)] AS vals,
           3 AS size, TRUE AS has, 'changed' AS after_set, ['key', 'region'] AS after_delete, 'other' AS merged
    FROM nation
""")
def q_map(spark, d):
    def f(n):
        m = F.create_map(F.lit("key"), n["n_nationkey"].cast("string"), F.lit("name"), n["n_name"], F.lit("region"), n["n_regionkey"].cast("string"))
        return V.record(
            n_nationkey=n["n_nationkey"], name=M.get(m, "name"), missing=M.get(m, "none"), keys=M.keys(m), vals=M.values(m), size=M.length(m), has=M.contains(m, "key"),
            after_set=M.get(M.set_key(m, "name", "changed"), "name"), after_delete=M.keys(M.delete(m, "name")), merged=M.get(M.merge(m, F.create_map(F.lit("region"), F.lit("other"))), "region"),
        )

    return Stream.of(table(spark, d, "nation"), "n_nationkey").map(f).records()


@query("""
    SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id * 2 ELSE -1 END AS mapped, CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'E: odd' END AS message,
           CASE WHEN user_id % 2 <> 0 THEN 'odd' WHEN user_id % 3 <> 0 THEN 'not by 3' END AS chained, user_id % 2 = 0 AS is_ok, CASE WHEN user_id % 2 = 0 THEN user_id ELSE 0 END AS plain
    FROM events
""")
def q_result(spark, d):
    def f(e):
        u = e["user_id"]
        r = R.result(u % 2 == 0, u, "odd")
        chained = R.then(r, lambda x: R.result(x % 3 == 0, x, "not by 3"))
        return V.record(event_id=e["event_id"], mapped=R.unwrap_or(R.map_ok(r, lambda x: x * 2), F.lit(-1).cast("long")), message=R.map_err(r, lambda m: F.concat(F.lit("E: "), m))["err"], chained=chained["err"], is_ok=R.is_ok(r), plain=R.ok_or(r, F.lit(0).cast("long")))

    return events(spark, d).map(f).records()


@query("SELECT event_id, CASE WHEN value > 5 THEN value + 1 ELSE 0.0 END AS mapped, value > 5 AS is_some, CASE WHEN value > 5 THEN NULL ELSE 'low' END AS err FROM events")
def q_option(spark, d):
    def f(e):
        o = F.struct((e["value"] > 5).alias("is_some"), F.when(e["value"] > 5, e["value"]).alias("value"))
        return V.record(event_id=e["event_id"], mapped=R.option_unwrap_or(R.option_map(o, lambda x: x + 1), 0.0), is_some=R.is_some(o), err=R.to_result(o, "low")["err"])

    return events(spark, d).map(f).records()


@query("SELECT event_id, user_id * 2 AS value, value + 1 AS some FROM events WHERE user_id % 2 = 0")
def q_unwrap(spark, d):
    even = events(spark, d).filter(lambda e: e["user_id"] % 2 == 0)
    return even.map(lambda e: V.record(event_id=e["event_id"], value=R.unwrap(R.result(e["user_id"] % 2 == 0, e["user_id"] * 2, "odd")), some=R.option_unwrap(R.some(e["value"] + 1)))).records()


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def q_json_get(spark, d):
    parsed = lambda e: F.try_parse_json(e["props"])
    f = lambda e: V.record(event_id=e["event_id"], k=V.variant_field(parsed(e), "$.k", "int"), missing=V.variant_field(parsed(e), "$.none", "string"))
    return events(spark, d).map(f).records()


@query("""SELECT '{"id":' || n_nationkey || ',"name":"' || n_name || '","none":null}' AS value FROM nation""")
def q_json_encode(spark, d):
    f = lambda n: J.encode(V.record(id=n["n_nationkey"], name=n["n_name"], none=F.lit(None).cast("int")))
    return Stream.of(table(spark, d, "nation"), "n_nationkey").map(f).records()


NUMBER = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


@query(f"""SELECT event_id, event_id % 9 <> 0 AS is_ok, CASE WHEN event_id % 9 <> 0 THEN '{{"v":' || {NUMBER.format("value")} || ',"xs":[' || user_id || ',null],"m":{{"' || event_type || '":true}}}}' END AS ok,
    CASE WHEN event_id % 9 = 0 THEN 'cannot encode NaN or Infinity to JSON' END AS err FROM events""")
def q_json_encode_result(spark, d):
    def f(e):
        number = F.when(e["event_id"] % 9 == 0, F.lit(float("nan"))).otherwise(e["value"])
        value = V.record(v=number, xs=F.array(e["user_id"], F.lit(None).cast("long")), m=F.create_map(e["event_type"], F.lit(True)))
        r = J.try_encode(value, "struct<v:double,xs:array<bigint>,m:map<string,boolean>>")
        return V.record(event_id=e["event_id"], is_ok=r["is_ok"], ok=r["ok"], err=r["err"])

    return events(spark, d).map(f).records()


@query("SELECT * REPLACE (upper(n_name) || '!' AS n_name), n_nationkey * 2 AS twice FROM nation")
def q_record_spread(spark, d):
    return Stream.of(table(spark, d, "nation"), "n_nationkey").map(lambda n: V.spread(n, n_name=F.concat(F.upper(n["n_name"]), F.lit("!")), twice=n["n_nationkey"] * 2)).records()


# --- sources, sinks, relations ----------------------------------------------------


@query("SELECT CAST(range AS BIGINT) AS value FROM range(3, 1000, 7)")
def q_range(spark, d):
    return readers.range_(spark, 3, 1000, 7).records()


@query("SELECT 42 AS value FROM range(100)")
def q_repeat(spark, d):
    return readers.repeat(spark, 42, 100).records()


@query("SELECT CAST(2 ** range AS BIGINT) AS value FROM range(40)")
def q_iterate(spark, d):
    return readers.iterate(spark, F.lit(1).cast("long"), lambda x: x * 2, 40).records()


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def q_group_reduce(spark, d):
    return events(spark, d).group_by(user_id=lambda e: e["user_id"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value.value"), 4).alias("total"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_nl_join(spark, d):
    nations = Stream.of(table(spark, d, "nation"), "n_nationkey")
    pairs = Stream.of(table(spark, d, "customer"), "c_custkey").join(nations, lambda c, n: c["c_nationkey"] == n["n_nationkey"])
    return pairs.map(lambda p: V.record(c_custkey=p["_1"]["c_custkey"], n_name=p["_2"]["n_name"])).records()


@query("SELECT r_name, n_name FROM region JOIN nation ON n_regionkey < r_regionkey")
def q_nl_join_condition(spark, d):
    regions, nations = Stream.of(table(spark, d, "region"), "r_regionkey"), Stream.of(table(spark, d, "nation"), "n_nationkey")
    return regions.join(nations, lambda r, n: n["n_regionkey"] < r["r_regionkey"]).map(lambda p: V.record(r_name=p["_1"]["r_name"], n_name=p["_2"]["n_name"])).records()


@query("SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region")
def q_union(spark, d):
    a = Stream.of(table(spark, d, "nation"), "n_nationkey").map(lambda n: n["n_name"])
    return a.union(Stream.of(table(spark, d, "region"), "r_regionkey").map(lambda r: r["r_name"])).records()


def _roundtrip(spark, stream: Stream, fmt: str) -> str:
    path = f"{shared_dir(spark)}/tidepipe/{uuid.uuid4().hex}/{fmt}"
    sink(stream, path, fmt)
    return path


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def q_csv_roundtrip(spark, d):
    return readers.csv(spark, _roundtrip(spark, Stream.of(table(spark, d, "nation"), "n_nationkey"), "csv")).filter_ok().records()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def q_tsv_roundtrip(spark, d):
    return readers.csv(spark, _roundtrip(spark, Stream.of(table(spark, d, "nation"), "n_nationkey"), "tsv"), sep="\t").filter_ok().records()


@query("SELECT event_id, user_id, event_type, value FROM events")
def q_jsonl_roundtrip(spark, d):
    rows = events(spark, d).map(lambda e: V.record(event_id=e["event_id"], user_id=e["user_id"], event_type=e["event_type"], value=e["value"]))
    return readers.jsonl(spark, _roundtrip(spark, rows, "jsonl"), "event_id long, user_id long, event_type string, value double").filter_ok().records()


@query("SELECT n_name AS value FROM nation")
def q_text_roundtrip(spark, d):
    return readers.text(spark, _roundtrip(spark, Stream.of(table(spark, d, "nation"), "n_nationkey").map(lambda n: n["n_name"]), "text")).records()


def _written(spark, stream: Stream, fmt: str, **options) -> DataFrame:
    """The lines that a sink has written, as text."""
    path = f"{shared_dir(spark)}/tidepipe/{uuid.uuid4().hex}/{fmt}"
    sink(stream, path, fmt, **options)
    return readers.text(spark, path).records()


@query("SELECT '{event_id: ' || event_id || ', value: ' || CAST(value AS VARCHAR) || ', xs: [' || user_id || ', nil]}' AS value FROM events")
def q_text_values(spark, d):
    return _written(spark, events(spark, d).map(lambda e: V.record(event_id=e["event_id"], value=e["value"], xs=F.array(e["user_id"], F.lit(None).cast("long")))), "text")


@query(f"SELECT unnest([CAST(user_id AS VARCHAR) || '', {NUMBER.format('value')}]) AS value FROM events")
def q_jsonl_lists(spark, d):
    return _written(spark, events(spark, d).map(lambda e: F.array(e["user_id"].cast("double"), e["value"])), "jsonl")


@query(f"""SELECT '{{"key":' || o_orderkey || ',"price":' || {NUMBER.format("o_totalprice")} || ',"pair":["' || o_orderstatus || '",' || o_custkey || ']}}' AS value FROM orders""")
def q_jsonl_nested(spark, d):
    return _written(spark, orders(spark, d).map(lambda o: V.record(key=o["o_orderkey"], price=o["o_totalprice"], pair=L.tuple_of(o["o_orderstatus"], o["o_custkey"]))), "jsonl")


@query("SELECT c_custkey || ',' || CAST(c_acctbal AS VARCHAR) || ',[' || c_nationkey || ']' AS value FROM customer")
def q_csv_values(spark, d):
    rows = Stream.of(table(spark, d, "customer"), "c_custkey").map(lambda c: V.record(key=c["c_custkey"], balance=c["c_acctbal"], nations=F.array(c["c_nationkey"])))
    return _written(spark, rows, "csv", header=False)


def _nations(spark, d) -> Stream:
    return Stream.of(table(spark, d, "nation"), "n_nationkey").map(lambda n: V.record(key=n["n_nationkey"], name=n["n_name"]))


@query("""SELECT '[' AS value UNION ALL SELECT CASE WHEN n_nationkey = 0 THEN '' ELSE ',' END || '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' FROM nation UNION ALL SELECT ']'""")
def q_json_folder(spark, d):
    """A document in another store is a folder; here the store is this machine's, by a scheme of its own."""
    return writers.folder_document(_nations(spark, d), "json", True, ",", 2)


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def q_json_source(spark, d):
    path = f"{shared_dir(spark)}/tidepipe/{uuid.uuid4().hex}"
    writers.folder_document(_nations(spark, d), "json_pretty", True, ",", 2).coalesce(1).write.text(path)
    return readers.json(spark, path, "struct<key:int,name:string>").filter_ok().records()


@query("""
    WITH w AS (SELECT greatest(3, max(strlen(CAST(n_nationkey AS VARCHAR)))) AS a, greatest(4, max(strlen(n_name))) AS b FROM nation)
    SELECT rtrim(rpad(CAST(n_nationkey AS VARCHAR), CAST(a AS INTEGER), ' ') || '  ' || rpad(n_name, CAST(b AS INTEGER), ' ')) AS value FROM nation, w
    UNION ALL SELECT rtrim(rpad('key', CAST(a AS INTEGER), ' ') || '  ' || rpad('name', CAST(b AS INTEGER), ' ')) FROM w
""")
def q_table(spark, d):
    return writers.folder_document(_nations(spark, d), "table", True, ",", 2)


@query("""
    WITH w AS (SELECT greatest(3, max(strlen(CAST(n_nationkey AS VARCHAR)))) AS a, greatest(4, max(strlen(n_name))) AS b FROM nation),
         c AS (SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS n FROM nation UNION ALL SELECT 'key', 'name' UNION ALL SELECT repeat('-', CAST(a AS BIGINT)), repeat('-', CAST(b AS BIGINT)) FROM w)
    SELECT '| ' || rpad(k, CAST(a AS INTEGER), ' ') || ' | ' || rpad(n, CAST(b AS INTEGER), ' ') || ' |' AS value FROM c, w
""")
def q_markdown(spark, d):
    return writers.folder_document(_nations(spark, d), "markdown", True, ",", 2)


@query("SELECT n_name AS value FROM nation UNION ALL SELECT n_name FROM nation")
def q_gzip_append(spark, d):
    names = Stream.of(table(spark, d, "nation"), "n_nationkey").map(lambda n: n["n_name"])
    path = f"{shared_dir(spark)}/tidepipe/{uuid.uuid4().hex}/gz"
    sink(names, path, "text", compress="gzip")
    sink(names, path, "text", compress="gzip", append=True, retry=2)
    return readers.text(spark, path).records()


@query("SELECT n_name AS value FROM nation")
def q_stdin(spark, d):
    return readers.stdin(spark, [f"{x}\n" for x in Stream.of(table(spark, d, "nation"), "n_nationkey").map(lambda n: n["n_name"]).collect()]).records()


@query("SELECT r_regionkey * 2 AS value FROM region")
def q_from_list(spark, d):
    return Stream.from_list(spark, Stream.of(table(spark, d, "region"), "r_regionkey").map(lambda r: r["r_regionkey"]).collect(), "int").map(lambda x: x * 2).records()


@query("""
    SELECT event_id, event_id % 50 <> 0 AS is_ok, CASE WHEN event_id % 50 <> 0 THEN event_id END AS id, CASE WHEN event_id % 50 = 0 THEN CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) END AS line,
        CASE WHEN event_id % 100 = 0 THEN 'expected string key in object' WHEN event_id % 50 = 0 THEN 'unexpected end of input' END AS message FROM events
""")
def q_jsonl_errors(spark, d):
    """Every fiftieth line is broken; the lines are read back from many files in order, as one."""
    broken = lambda e: F.when(e["event_id"] % 100 == 0, F.lit("{broken}")).when(e["event_id"] % 50 == 0, F.lit('{"id":')).otherwise(F.concat(F.lit('{"id":'), e["event_id"].cast("string"), F.lit("}")))
    path = f"{shared_dir(spark)}/tidepipe/{uuid.uuid4().hex}"
    events(spark, d).map(broken).df.orderBy("_o0").select("value").coalesce(1).write.text(path)
    numbered = readers.jsonl(spark, path, "id long").indexed().df.withColumn("event_id", F.col("_o0") + events(spark, d).map(lambda e: e["event_id"]).min())
    return numbered.select("event_id", "value.is_ok", F.col("value.ok.id").alias("id"), F.col("value.err.line").alias("line"), F.col("value.err.message").alias("message"))


@query("SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total, FALSE AS failed_is_ok FROM events")
def q_spawn_join(spark, d):
    n, total = jobs.spawn(lambda: events(spark, d).count()), jobs.spawn(lambda: events(spark, d).map(lambda e: e["user_id"]).sum())
    failed = jobs.spawn(lambda: 1 // 0)
    return one_row(spark, n=F.lit(jobs.join(n)["ok"]).cast("long"), total=F.lit(jobs.join(total)["ok"]).cast("long"), failed_is_ok=jobs.join(failed)["is_ok"])


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def q_pricing_summary(spark, d):
    kept = Stream.of(table(spark, d, "lineitem"), "l_orderkey").filter(lambda x: x["l_shipdate"] <= F.lit("1998-09-02").cast("timestamp_ntz"))
    revenue = F.sum(F.col("value.l_extendedprice") * (1 - F.col("value.l_discount")))
    return kept.group_by(l_returnflag=lambda x: x["l_returnflag"], l_linestatus=lambda x: x["l_linestatus"]).agg(F.round(F.sum("value.l_quantity"), 2).alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


# --- unbounded streams, run to the end of what is there ---------------------------

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _unbounded(spark: SparkSession, d: str) -> DataFrame:
    return streams.records(spark, f"{d}/events.parquet*", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(df: DataFrame, mode: str = "append", rate: int | None = None) -> DataFrame:
    """What a stream writes until its input is used up; in complete mode each micro-batch replaces what was."""
    path = f"{shared_dir(df.sparkSession)}/tidepipe/{uuid.uuid4().hex}"
    writer = df.writeStream.option("checkpointLocation", f"{path}/state")
    if mode == "complete":
        writer = writer.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/out"))
    else:
        writer = writer.format("parquet").option("path", f"{path}/out")
    if rate is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        run = streams.throttled(writer, rate).start()
        run.processAllAvailable()
        run.stop()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def _batched(spark: SparkSession, d: str, last: bool) -> DataFrame:
    """Sums of the lists of 50 of each type's events, with the unfilled ones if ``last``."""
    folder = f"{shared_dir(spark)}/tidepipe/{uuid.uuid4().hex}"
    run = stateful.batches_to(_unbounded(spark, d), 50, "event_type", "event_id", "user_id", folder).trigger(availableNow=True).start()
    run.awaitTermination()
    lists = stateful.results(spark, folder)
    if last:
        lists = lists.unionByName(stateful.unfilled(spark, folder, "event_type", run.lastProgress["batchId"]))
    return lists.select("event_type", "batch", F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'purchase'")
def q_stream_filter_map(spark, d):
    return _drained(_unbounded(spark, d).where("event_type = 'purchase'").select("event_id", J.decode(F.col("props"), "k int")["ok"]["k"].alias("k")))


@query("SELECT event_type, event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS DOUBLE) AS user_id FROM events")
def q_stream_scan(spark, d):
    folder, add = f"{shared_dir(spark)}/tidepipe/{uuid.uuid4().hex}", lambda a, x: a + x
    stateful.scan_to(_unbounded(spark, d), "event_type", "event_id", "user_id", 0.0, add, add, folder).trigger(availableNow=True).start().awaitTermination()
    return stateful.results(spark, folder)


@query("SELECT DISTINCT event_type FROM events")
def q_stream_distinct(spark, d):
    return _drained(stateful.distinct(_unbounded(spark, d), ["event_type"], "ts", "3650 days").select("event_type"))


@query("""
    WITH r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY event_type) AS all_n FROM events)
    SELECT event_type, n // 50 AS batch, CAST(sum(user_id) AS BIGINT) AS total FROM r WHERE n // 50 < all_n // 50 GROUP BY ALL
""")
def q_stream_batch(spark, d):
    return _batched(spark, d, last=False)


@query("""
    WITH r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events)
    SELECT event_type, n // 50 AS batch, CAST(sum(user_id) AS BIGINT) AS total FROM r GROUP BY ALL
""")
def q_stream_batch_all(spark, d):
    return _batched(spark, d, last=True)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_windows(spark, d):
    counts = stateful.windowed(_unbounded(spark, d), "ts", "10 minutes", "1 hour", None, F.count(F.lit(1)).alias("n"), by=("event_type",))
    return _drained(counts, mode="complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
    WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events),
         s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session
""")
def q_stream_sessions(spark, d):
    found = stateful.sessions(_unbounded(spark, d), "ts", "10 minutes", "1 day", F.count(F.lit(1)).alias("n"), by=("user_id",))
    return _drained(found, mode="complete").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, user_id FROM events")
def q_stream_throttled(spark, d):
    return _drained(_unbounded(spark, d).select("event_id", "user_id"), rate=100_000)
