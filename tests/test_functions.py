import pytest
from pyspark.sql import functions as F

from tidepipe.functions import json as J
from tidepipe.functions import lists as L
from tidepipe.functions import maps as M
from tidepipe.functions import results as R
from tidepipe.functions import strings as S
from tidepipe.functions import values as V


@pytest.fixture
def ev(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()["x"]


def test_strings(ev):
    s = F.lit
    assert ev(S.split(s("a,b,c"), ",")) == ["a", "b", "c"] and ev(S.split(s(""), ",")) == [""] and ev(S.split(s("ab"), "")) == ["a", "b"]
    assert ev(S.split(s("a..b"), ".")) == ["a", "", "b"]
    assert ev(S.trim(s(" \t hello \r\n"))) == "hello" and ev(S.trim(s(""))) == ""
    assert ev(S.join(F.array(s("x"), s(None), s("z")), "-")) == "x-nil-z"
    assert ev(S.contains(s("hello"), "")) and not ev(S.contains(s("hello"), "xyz"))
    assert ev(S.replace(s("aabbcc"), "bb", "XX")) == "aaXXcc" and ev(S.replace(s("ab"), "", "x")) == "ab"
    assert ev(S.starts_with(s("hello"), "hel")) and ev(S.ends_with(s("hello"), "llo"))
    assert ev(S.to_upper(s("Hé llo"))) == "Hé LLO" and ev(S.to_lower(s("HÉ"))) == "hÉ"
    assert ev(S.length(s("é"))) == 2


def test_lists(ev):
    xs = F.array(*map(F.lit, (3, 1, 2)))
    assert (ev(L.get(xs, 0)), ev(L.get(xs, 9)), ev(L.get(xs, -1))) == (3, None, None)
    assert ev(L.set_at(xs, 1, 9)) == [3, 9, 2] and ev(L.append(xs, 4)) == [3, 1, 2, 4] and ev(L.length(xs)) == 3
    with pytest.raises(Exception, match="out of bounds"):
        ev(L.set_at(xs, 7, 9))
    assert ev(L.map_(xs, lambda x: x * 10)) == [30, 10, 20] and ev(L.filter_(xs, lambda x: x > 1)) == [3, 2]
    assert ev(L.reduce(xs, 0, lambda a, x: a + x)) == 6 and ev(L.sort(xs)) == [1, 2, 3] and ev(L.reverse(xs)) == [2, 1, 3]
    assert ev(L.sort_by(xs, lambda x: -x)) == [3, 2, 1]
    assert [tuple(p) for p in ev(L.zip_(xs, F.array(F.lit(7), F.lit(8))))] == [(3, 7), (1, 8)]
    assert ev(L.flatten(F.array(xs, F.lit(None).cast("array<int>")))) == [3, 1, 2]
    assert ev(L.contains(xs, 2)) and not ev(L.contains(F.array_append(xs, F.lit(None)), 99))
    assert ev(L.filter_map(xs, lambda x: F.when(x > 1, x * 10))) == [30, 20]
    assert ev(L.avg(xs)) == 2.0 and ev(L.avg(F.array().cast("array<int>"))) is None
    t = L.tuple_of(1, "a")
    assert ev(L.tuple_get(t, 1, 2)) == "a" and ev(L.tuple_get(t, 5, 2)) is None


def test_maps(ev):
    m = F.create_map(F.lit("name"), F.lit("alice"), F.lit("age"), F.lit("30"))
    assert (ev(M.get(m, "name")), ev(M.get(m, "none"))) == ("alice", None)
    assert list(ev(M.set_key(m, "name", "bob")).items()) == [("name", "bob"), ("age", "30")]
    assert ev(M.delete(m, "age")) == {"name": "alice"} and ev(M.keys(m)) == ["name", "age"] and ev(M.values(m)) == ["alice", "30"]
    assert ev(M.merge(m, F.create_map(F.lit("age"), F.lit("99"), F.lit("b"), F.lit("2")))) == {"name": "alice", "age": "99", "b": "2"}
    assert ev(M.contains(F.create_map(F.lit("a"), F.lit(None).cast("string")), "a")) and ev(M.length(m)) == 2


def test_results(ev):
    good, bad = R.ok(42), R.err("not found", "int")
    assert ev(R.map_ok(good, lambda x: x * 2))["ok"] == 84 and ev(R.map_ok(bad, lambda x: x * 2))["err"] == "not found"
    assert ev(R.map_err(bad, lambda e: F.concat(F.lit("E: "), e)))["err"] == "E: not found"
    assert (ev(R.unwrap_or(good, 0)), ev(R.unwrap_or(bad, 0)), ev(R.ok_or(bad, 7))) == (42, 0, 7)
    div = lambda d: lambda x: R.result(F.lit(d) != 0, F.expr("try_divide(10, %d)" % d), "division by zero")
    assert ev(R.then(R.ok(10), div(2)))["ok"] == 5 and ev(R.then(R.ok(10), div(0)))["err"] == "division by zero"
    assert ev(R.is_ok(good)) and ev(R.is_err(bad)) and ev(R.unwrap(good)) == 42
    with pytest.raises(Exception, match="unwrap called on Err or None"):
        ev(R.unwrap(bad))
    some, none = R.some("hello"), R.none("string")
    assert ev(R.option_map(some, F.upper))["value"] == "HELLO" and ev(R.option_unwrap_or(none, "d")) == "d"
    assert ev(R.is_some(some)) and ev(R.is_none(none)) and ev(R.to_result(none, "no"))["err"] == "no" and ev(R.option_unwrap(some)) == "hello"


def test_values(ev):
    assert ev(V.int_div(F.lit(-7), F.lit(2))) == -3 and ev(F.lit(-7) % 3) == -1
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        ev(V.int_div(F.lit(1), F.lit(0)))
    with pytest.raises(Exception, match="OVERFLOW"):
        ev(F.lit(2147483647) + F.lit(1))
    assert ev(V.equal(F.lit(None), None)) and not ev(V.equal(F.lit(float("nan")), float("nan"), floats=True))
    grade = lambda n: V.match(F.lit(n)).arm(100, "perfect").arm(lambda x: F.lit(True), "A", when=lambda x: x >= 90).otherwise("low")
    assert (ev(grade(100)), ev(grade(95)), ev(grade(1))) == ("perfect", "A", "low")
    with pytest.raises(Exception, match="no matching pattern"):
        ev(V.match(F.lit(5)).arm(1, "one").end())
    xs = F.array(F.lit(1), F.lit(2))
    assert ev(V.match(xs).arm(V.list_of(3), "three").arm(V.list_of(1, rest=True), "some").otherwise("none")) == "some"
    shape = V.tagged("Rect", w=3.0, h=4.0)
    assert ev(V.match(shape).arm(V.variant("Circle"), 0.0).arm(V.variant("Rect"), lambda s: s["w"] * s["h"]).end()) == 12.0
    assert ev(V.spread(V.record(name="a", age=1), age=2, new=3)).asDict() == {"name": "a", "age": 2, "new": 3}
    assert ev(V.to_text(F.lit(2.0), "double")) == "2.0" and ev(V.to_text(F.lit(1e10), "double")) == "10000000000.0" and ev(V.to_text(F.lit(None))) == "nil"
    assert ev(V.if_else(F.lit(False), 1)) is None and ev(V.type_of(F.lit(1))) == "int" and ev(V.concat("a", "b")) == "ab"
    with pytest.raises(Exception, match="boom"):
        ev(V.panic("boom"))


def test_json(ev):
    for text, good in [("42", True), ("null", True), ("[1, 2]", True), ("{}", True), ("not json", False), ("", False)]:
        assert ev(J.decode(F.lit(text))["is_ok"]) is good
    assert ev(J.decode(F.lit('{"a": 1}'), "a int")["ok"]).a == 1
    assert ev(J.decode(F.lit("  bad"))["err"]["position"]) == 2
    assert ev(J.encode(F.array(F.lit(1), F.lit(2)))) == "[1,2]" and ev(J.encode(F.lit("h\"i"), "string")) == '"h\\"i"'
    assert ev(J.encode(F.lit(3.0), "double")) == "3" and ev(J.encode(F.lit(True), "boolean")) == "true" and ev(J.encode(F.lit(None), "int")) == "null"
    assert ev(J.encode(V.record(a=None))) == '{"a":null}'
