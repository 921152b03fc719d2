import gzip
import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidepipe.operators.stream import Stream
from tidepipe.functions.json import problem_of
from tidepipe.plans.staging import shared_dir
from tidepipe.sinks import writers
from tidepipe.sinks.writers import folder_document, pieces_of, show, sink
from tidepipe.sources import readers
from tidepipe.sources.http import http

from tidepipe.sources.stores import azure_conf, gs_conf, s3_conf

JSONL = '{"name": "alice", "age": 30}\n{"name": "bob", "age": 25}\nnot valid json\n{"name": "carol", "age": 41}\n'


@pytest.fixture
def people(spark):
    return Stream.from_list(spark, [("alice", 30, "NYC"), ("bob", 25, "LA")], "struct<name:string,age:int,city:string>")


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_text(spark, tmp_path):
    path = put(tmp_path, "a.txt", "hello world\nfoo bar\r\n\nlast line")
    assert readers.source(spark, path).collect() == ["hello world", "foo bar", "", "last line"]
    assert readers.source(spark, "file://" + path).count() == 4
    with pytest.raises(ValueError, match="unsupported URI scheme"):
        readers.text(spark, "ftp://x/y")


def test_jsonl(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", JSONL)
    s = readers.jsonl(spark, path, "name string, age int", lines=True)
    assert [r["is_ok"] for r in s.collect()] == [True, True, False, True]
    assert [tuple(e) for e in s.filter_err().collect()] == [("invalid literal (expected 'null')", 3)]
    assert [x["name"] for x in s.filter_ok().collect()] == ["alice", "bob", "carol"]
    dynamic = readers.jsonl(spark, path).filter_ok().map(lambda v: F.variant_get(v, "$.age", "int"))
    assert dynamic.collect() == [30, 25, 41]


def test_json(spark, tmp_path):
    path = put(tmp_path, "a.json", '[{"name":"alice","total":30},{"name":"bob","total":25},{"name":"charlie","total":35}]')
    top = readers.json(spark, path, "struct<name:string,total:int>").filter_ok().sort_by(lambda r: r["total"], descending=True).first()
    assert (top["name"], top["total"]) == ("charlie", 35)
    assert readers.json(spark, path).filter_ok().map(lambda v: F.variant_get(v, "$.name", "string")).collect() == ["alice", "bob", "charlie"]
    one = readers.json(spark, put(tmp_path, "b.json", '{"name":"alice","total":42}'), "struct<name:string,total:int>").single()
    assert one["is_ok"] and one["ok"]["ok"]["total"] == 42
    bad = readers.json(spark, put(tmp_path, "c.json", "[1, 2")).collect()
    assert len(bad) == 1 and not bad[0]["is_ok"] and bad[0]["err"]["position"] == 5
    many = readers.json(spark, put(tmp_path, "d.json", '[\n  {"name": "a"},\n  {"name": "b"}\n]\n'), "struct<name:string>").filter_ok().collect()
    assert [x["name"] for x in many] == ["a", "b"]


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'a,b,c\n1,"x ""y"", z",3\n4\n\n5,6,7\n')
    rows = readers.csv(spark, path).filter_ok().collect()
    assert [tuple(r) for r in rows] == [("1", 'x "y", z', "3"), ("4", None, None), ("5", "6", "7")]


def lines(path):
    return path.read_text().split("\n")


def test_single_file_sinks(spark, people, tmp_path):
    out = tmp_path / "out"
    sink(people, str(out), "csv", single=True)
    assert lines(out) == ["name,age,city", "alice,30,NYC", "bob,25,LA", ""]
    sink(people, str(out), "csv", single=True, header=False, append=True)
    assert lines(out)[3] == "alice,30,NYC"
    sink(people, str(out), "tsv", single=True)
    assert lines(out)[1] == "alice\t30\tNYC"
    sink(people, str(out), "jsonl", single=True)
    assert lines(out)[0] == '{"name":"alice","age":30,"city":"NYC"}'
    sink(people, str(out), "json")
    assert out.read_text() == '[{"name":"alice","age":30,"city":"NYC"},{"name":"bob","age":25,"city":"LA"}]\n'
    sink(people.map(lambda p: F.struct(p["name"].alias("name"))), str(out), "json_pretty")
    assert len(lines(out)) == 9 and lines(out)[2] == '    "name": "alice"'
    sink(people, str(out), "table")
    assert lines(out)[:2] == ["name   age  city", "alice  30   NYC"]
    sink(people, str(out), "markdown")
    assert lines(out)[:3] == ["| name  | age | city |", "| ----- | --- | ---- |", "| alice | 30  | NYC  |"]
    sink(people.map(lambda p: p["name"]), str(out), "text", single=True, compress="gzip")
    assert gzip.open(out, "rt").read() == "alice\nbob\n"
    with pytest.raises(ValueError, match="HTTP sink"):
        sink(people, "http://x/y")


def test_folder_sinks_and_globs(spark, people, tmp_path):
    for fmt in ("csv", "jsonl", "tsv"):
        sink(people, str(tmp_path / fmt), fmt)
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "csv")).filter_ok().collect()] == [("alice", "30", "NYC"), ("bob", "25", "LA")]
    assert [r["age"] for r in readers.jsonl(spark, str(tmp_path / "json*"), "name string, age int, city string").filter_ok().collect()] == [30, 25]
    sink(people, str(tmp_path / "jsonl"), "jsonl", append=True, compress="gzip")
    assert readers.jsonl(spark, str(tmp_path / "jsonl")).count() == 4


def test_stdout(people, capsys):
    sink(people.map(lambda p: p["age"]), "stdout")
    assert capsys.readouterr().out == "30\n25\n"


def test_stdin_and_show(spark, capsys):
    s = readers.stdin(spark, ["a\n", "\n", "b"])
    assert s.collect() == ["a", "", "b"] and s.show(1) is s
    assert capsys.readouterr().out == "a\n"


def test_show():
    assert show([1, None, True, 2.0, 1e10, {"a": [1.5]}]) == "[1, nil, true, 2.0, 10000000000.0, {a: [1.5]}]"


def test_http(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), http_server_handler())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/a"
    assert http(spark, url).collect() == ['{"k": 1}', "bad", "last"]
    got = readers.source(spark, url, "jsonl", schema="k int").collect()
    assert [(r["is_ok"], r["err"] and r["err"]["line"]) for r in got] == [(True, None), (False, 2), (False, 3)]
    body["text"] = b'[{"a": 1},\n {"a": 2}]'
    assert [r["ok"]["a"] for r in http(spark, url, "json", "struct<a:int>").collect()] == [1, 2]
    body["text"] = b'a,b\r\n1,"x, y"\r\n2\r\n'
    assert [tuple(r) for r in http(spark, url, "csv").filter_ok().collect()] == [("1", "x, y"), ("2", None)]
    server.shutdown()


body = {}


def http_server_handler():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            text = body.get("text", b'{"k": 1}\nbad\r\nlast')
            self.send_response(200)
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *a):
            pass

    return Handler


def test_credentials(tmp_path, monkeypatch):
    monkeypatch.setenv("AWS_ACCESS_KEY_ID", "id")
    monkeypatch.setenv("AWS_SECRET_ACCESS_KEY", "secret")
    assert s3_conf()["fs.s3a.access.key"] == "id"
    (tmp_path / "cred").write_text("[p]\naws_access_key_id = x\naws_secret_access_key = y\n")
    monkeypatch.setenv("AWS_SHARED_CREDENTIALS_FILE", str(tmp_path / "cred"))
    assert s3_conf("p")["fs.s3a.secret.key"] == "y"
    assert s3_conf({"access_key": "k", "secret_key": "s"})["fs.s3a.access.key"] == "k"
    assert gs_conf({"key_file": "/k"})["fs.gs.auth.service.account.json.keyfile"] == "/k" and gs_conf({}) == {}
    assert list(azure_conf({"account": "a", "key": "k"}).values()) == ["k"]


def test_one_document_is_written_as_its_elements_come(spark, tmp_path):
    taken = []
    pieces = pieces_of((taken.append(i) or {"a": i, "b": ["x\ny"], "c": {}} for i in range(1000)), "json")
    assert next(pieces) + next(pieces) == '[{"a":0,"b":["x\\ny"],"c":{}}' and len(taken) == 1
    for n, indent in ((0, 2), (1, 2), (3, 4), (2, 0)):
        values = [{"a": i, "b": ["x\ny"], "c": {}, "d": []} for i in range(n)]
        assert "".join(pieces_of(iter(values), "json_pretty", indent=indent)) == json.dumps(values, indent=indent) + "\n"
        assert json.loads("".join(pieces_of(iter(values), "json"))) == values
    numbers = Stream.of(spark.range(1000).repartition(5), "id")
    sink(numbers.map(lambda r: F.struct(r["id"].alias("i"), F.lit("é").alias("name"))), str(tmp_path / "t"), "table")
    lines = (tmp_path / "t").read_text().split("\n")
    assert lines[0] == "i    name" and lines[1] == "0    é" and lines[1000] == "999  é" and len(lines) == 1002
    sink(numbers.filter(lambda r: r["id"] < 0), str(tmp_path / "e"), "table")
    assert (tmp_path / "e").read_text() == ""


def test_folders_and_files_hold_the_same_text(spark, tmp_path):
    rows = [(None, [1.0, None], {"k": 1e10}, ("x", True), 'say "hi", you'), (2.5, [], {}, None, " a "), (-1e-7, None, None, ("y", None), "")]
    s = Stream.from_list(spark, rows, "struct<d:double,xs:array<double>,m:map<string,double>,t:struct<_1:string,_2:boolean>,s:string>")
    for fmt in ("text", "jsonl", "csv", "tsv"):
        sink(s, str(tmp_path / "one"), fmt, single=True, header=False)
        sink(s, str(tmp_path / f"{fmt}-many"), fmt, header=False)
        parts = sorted((tmp_path / f"{fmt}-many").glob("part-*"))
        assert "".join(p.read_text() for p in parts) == (tmp_path / "one").read_text(), fmt
    sink(s, str(tmp_path / "one"), "text", single=True)
    assert (tmp_path / "one").read_text().split("\n")[0] == '{d: nil, xs: [1.0, nil], m: {k: 10000000000.0}, t: (x, true), s: say "hi", you}'
    sink(s, str(tmp_path / "one"), "jsonl", single=True)
    assert (tmp_path / "one").read_text().split("\n")[1] == '{"d":2.5,"xs":[],"m":{},"t":null,"s":" a "}'
    for fmt in ("json", "json_pretty"):
        assert len(json.loads("\n".join(r.value for r in folder_document(s, fmt, True, ",", 2).collect()))) == 3
    maps = Stream.from_list(spark, [{"a": 1, "b": 2}, {"b": 3}], "map<string,int>")
    sink(maps, str(tmp_path / "m"), "csv", single=True)
    assert (tmp_path / "m").read_text() == "a,b\n1,2\n,3\n"
    nan = Stream.from_list(spark, [float("nan")], "double")
    with pytest.raises(Exception, match="cannot encode NaN"):
        sink(nan, str(tmp_path / "n"), "jsonl", single=True)
    with pytest.raises(ValueError, match="timeout"):
        sink(s, str(tmp_path / "x"), timeout=0)


def test_writes_are_tried_again(monkeypatch):
    monkeypatch.setattr(writers, "FIRST_PAUSE", 0.0)
    calls = []

    def write():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")

    writers.attempt(write, 2)
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        writers.attempt(write, 1)


def test_locations(monkeypatch):
    monkeypatch.delenv("AZURE_STORAGE_ACCOUNT", raising=False)
    assert readers.location("az://c/b/x", "acc") == "abfss://c@acc.dfs.core.windows.net/b/x"
    assert readers.location("az://c@acc.dfs.core.windows.net/b") == "abfss://c@acc.dfs.core.windows.net/b"
    with pytest.raises(ValueError, match="account"):
        readers.location("az://c/b")
    above, pattern = readers.crossing("s3://b/logs/2024*/x?.jsonl")
    assert above == "s3://b/logs" and re.search(pattern, "s3a://b/logs/2024/05/x1.jsonl") and not re.search(pattern, "s3a://b/logs/2024/x10.jsonl")
    assert readers.crossing("s3://b/x.jsonl") is None and readers.crossing("/a/*.jsonl") is None
    assert gs_conf({"access_key": "a", "secret_key": "s"})["fs.s3a.endpoint"].endswith("googleapis.com")


@pytest.mark.parametrize(
    "text, message, position",
    [
        ("{broken: json}", "expected string key in object", 1), ("[1,2", "expected ',' or ']' in array", 4), ('{"a":[1,{}] 3}', "expected ',' or '}' in object", 12), ('{"a" 1}', "expected ':' after object key", 5),
        ("01", "leading zeros not allowed", 1), ("1.", "expected digit after decimal point", 2), ('"abc', "unterminated string", 0), ("", "unexpected end of input", 0), ("1 2", "unexpected content after value", 2),
        ('{"a":1,}', "expected string key in object", 7), ("NaN", "unexpected character", 0), ("tru", "invalid literal (expected 'true')", 0),
    ],
)
def test_json_problems(text, message, position):
    assert problem_of(text) == (message, position)


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(type("Session", (), {"conf": Conf()})())
