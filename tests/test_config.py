import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import config as C, risk as R


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, content string")


def changes(spark, old, new, **options):
    rows = C.json_diff(docs(spark, json.dumps(old)), docs(spark, json.dumps(new)), "id", "content", **options).collect()
    return {(r.path, r.change): (r.old_value, r.new_value) for r in rows}


def test_flatten(spark):
    content = '{"a":{"b":1,"c.d":"x"},"e":[1,{"k":"v"}],"n":null,"o":{},"t":true,"s":"5","f":1.5}'
    got = {(r.path, r.type): r.value for r in C.flatten_json(docs(spark, content), "id", "content").collect()}
    assert got == {
        ("a.b", "number"): "1", ("a.c.d", "string"): "x", ("e", "array"): '[1,{"k":"v"}]', ("n", "null"): "null",
        ("o", "object"): "{}", ("t", "boolean"): "true", ("s", "string"): "5", ("f", "number"): "1.5",
    }


def test_json_diff(spark):
    old = {"same": {"x": 1}, "gone": {"deep": {"y": 1}}, "v": 1, "arr": [1, 2], "kind": {"a": 1}, "null": None, "text": "5", "e": {}}
    new = {"same": {"x": 1}, "fresh": {"deep": [1]}, "v": 2, "arr": [2, 1], "kind": [1], "null": 0, "text": 5, "e": {"z": None}}
    assert changes(spark, old, new) == {
        ("gone", "removed"): ('{"deep":{"y":1}}', None), ("fresh", "added"): (None, '{"deep":[1]}'), ("v", "value"): ("1", "2"),
        ("arr", "array"): ("[1,2]", "[2,1]"), ("kind", "value"): ('{"a":1}', "[1]"), ("null", "value"): ("null", "0"),
        ("text", "value"): ("5", "5"), ("e.z", "added"): (None, "null"),
    }
    assert changes(spark, old, old) == {}
    assert changes(spark, {"a": 1, "b": 2}, {"b": 2, "a": 1}) == {}
    assert changes(spark, {"a.b": 1}, {"a": {"b": 1}}) == {("a.b", "removed"): ("1", None), ("a", "added"): (None, '{"b":1}')}


def _nested(depth, leaf, lists=False):
    for i in range(depth):
        leaf = [leaf] if lists and i % 2 else {f"n{i}": leaf}
    return leaf


@pytest.mark.parametrize("depth", [25, 500])
def test_any_depth(spark, depth):
    path = ".".join(f"n{i}" for i in reversed(range(depth)))
    wide = {f"w{i}": {"x": {}} for i in range(300)}
    assert changes(spark, {**_nested(depth, 1), **wide}, {**_nested(depth, 2), **wide}) == {(path, "value"): ("1", "2")}
    rows = C.flatten_json(docs(spark, json.dumps({**_nested(depth, 1), **wide})), "id", "content").collect()
    assert len(rows) == 301 and (path, "1") in {(r.path, r.value) for r in rows}
    secret = C.redact_json(docs(spark, json.dumps(_nested(depth, {"token": "t", "n": [[["x"]]]}, lists=True))), "id", "content").collect()
    assert {r.path.split(".")[-1]: r.value for r in secret} == {"token": "", "0": "x"} and {len(r.path.split(".")) for r in secret} == {depth + 1, depth + 4}


BAD = ('{"a":1', '{"a":1,"a":2}', "", "not json", '{"b":{"x":1,"x":1}}')


def test_bad_files_do_not_stop_the_others(spark):
    frame = docs(spark, '{"a":1}', *BAD, None)
    assert {r.id: r.path for r in C.flatten_json(frame, "id", "content").collect() if r.path} == {0: "a"}
    errors = {r.id: r.error for r in C.json_errors(frame, "id", "content").collect()}
    assert set(errors) == {1, 2, 3, 4, 5} and "repeated" in errors[2] and "repeated" in errors[5] and "no readable" in errors[1]
    assert C.json_diff(frame, docs(spark, '{"a":2}', *['{"a":1}'] * 6), "id", "content").where("id < 6").select("id", "new_value").collect() == [(0, "2")]
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    old = files(("a.json", '{"a":1}'), ("b.json", "{"), ("c.json", '{"k":1,"k":1}'), ("gone.json", "x"))
    new = files(("a.json", '{"a":2}'), ("b.json", "{}"), ("c.json", "["), ("new.json", "y"))
    report = C.drift_report(old, new)
    assert {(r.path, r.file_status, r.change) for r in report.collect()} == {
        ("a.json", "common", "value"), ("b.json", "common", "error"), ("c.json", "common", "error"), ("gone.json", "removed", "file"),
        ("new.json", "added", "file"), ("new.json", "added", "error"),
    }
    assert {r.path: r.content for r in C.clean_files(old, new, report=report).collect()} == {"a.json": '{"a":2}', "new.json": None}
    assert {r.path for r in C.drift_files(report).collect()} == {"a.json", "gone.json", "new.json"}
    assert R.config_risk(files(("x.json", "{"), ("y.json", '{"debug":true}'))).collect() == [("y.json", "debug", "debug_setting")]


SECRETS = {
    "user": "u", "Password": "p", "n_tokens": 3, "list": [{"secret": "s"}, "plain"],
    "keys": {"inner_key": "i", "name": "n"}, "token": ["t", {"a": "b"}],
}


def test_redaction(spark):
    frame = docs(spark, json.dumps(SECRETS))
    plain = {r.path: r.value for r in C.redact_json(frame, "id", "content").collect()}
    assert plain == {
        "user": "u", "Password": "", "n_tokens": "3", "list.0.secret": "", "list.1": "plain", "keys.inner_key": "i",
        "keys.name": "n", "token.0": "t", "token.1.a": "b",
    }
    deep = {r.path: r.value for r in C.redact_json(frame, "id", "content", deep=True).collect()}
    assert deep == {**plain, "keys.inner_key": "", "keys.name": "", "token.0": "", "token.1.a": ""}
    cleaned = lambda deep: json.loads(frame.select(C.clean_json(frame.content, deep).alias("c")).first().c)
    assert cleaned(False) == {**SECRETS, "Password": "", "list": [{"secret": ""}, "plain"]}
    assert cleaned(True)["keys"] == {"inner_key": "", "name": ""} and cleaned(True)["token"] == ["", {"a": ""}]


def env(spark, text, path="a.env"):
    return spark.createDataFrame([(path, i, line) for i, line in enumerate(text.split("\n"))], "path string, line_no int, line string")


def test_env(spark):
    text = "# c=1\n\n A = 1 \nB=x=y\n=no\nnone\nA=2\nMY_KEY=k"
    got = [(r.line_no, r.key, r.value) for r in C.parse_env(env(spark, text), "path").orderBy("line_no").collect()]
    assert got == [(2, "A", "1"), (3, "B", "x=y"), (6, "A", "2"), (7, "MY_KEY", "k")]
    new = env(spark, "A=2\nC=\nB=z")
    rows = C.env_diff(C.parse_env(env(spark, text), "path"), C.parse_env(new, "path"), "path").collect()
    assert {(r.key, r.change): (r.old_value, r.new_value) for r in rows} == {
        ("B", "changed"): ("x=y", "z"), ("C", "added"): (None, ""), ("MY_KEY", "removed"): ("k", None),
    }
    lines = [r.line for r in C.redact_env(env(spark, text), "path").orderBy("line_no").collect()]
    assert lines == ["# c=1", "", "A = 1", "B=x=y", "=no", "none", "A=2", "MY_KEY="]


def test_report(spark):
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    old = files(("A/x.json", '{"a":1,"api_key":"o","db":{"password":"p"}}'), ("b.env", "A=1\nTOKEN=t"), ("gone.json", "{}"), ("same.env", "A=1"))
    new = files(("a/X.json", '{"a":"q","api_key":"n","more":{"secret":"s","l":[1]}}'), ("b.env", "A=2\nTOKEN=u\nB=1"), ("new.env", "K=v\nMY_KEY=s"), ("same.env", "A=1"))
    lines = sorted(r.line for r in C.drift_report(old, new).collect())
    assert lines == sorted([
        "- gone.json", "+ new.env", "~ Changed Value: a from '1' to 'q'", "~ Changed Value: api_key from '' to ''",
        '- Removed Property: db = {"password":""}', '+ Added Property: more = {"l":[1],"secret":""}',
        "~ Changed Variable: A from '1' to '2'", "~ Changed Variable: TOKEN from '' to ''", "+ Added Variable: B = 1",
    ])
    open_lines = [r.line for r in C.drift_report(old, new, redact=False).collect()]
    assert "~ Changed Variable: TOKEN from 't' to 'u'" in open_lines and "~ Changed Value: api_key from 'o' to 'n'" in open_lines
    clean = {r.path: r.content for r in C.clean_files(old, new).collect()}
    assert clean == {
        "a/X.json": '{"a":"q","api_key":"","more":{"secret":"","l":[1]}}', "b.env": "A=2\nTOKEN=\nB=1", "new.env": "K=v\nMY_KEY=",
    }
    assert {r.path: (r.file_status, r.n_changes) for r in C.drift_files(C.drift_report(old, new)).collect()} == {
        "a/X.json": ("common", 4), "b.env": ("common", 3), "gone.json": ("removed", 1), "new.env": ("added", 1),
    }
    risky = files(("a.json", '{"debug":true,"keys":[{"token":"x"}],"mode":"development","key":""}'), ("b.env", "APP_DEBUG=1\nPASSWORD=x\nSECRET="))
    assert {(r.path, r.item, r.risk) for r in R.config_risk(risky).collect()} == {
        ("a.json", "debug", "debug_setting"), ("a.json", "keys.0.token", "secret_value"), ("a.json", "mode", "debug_setting"),
        ("b.env", "APP_DEBUG", "debug_setting"), ("b.env", "PASSWORD", "secret_value"),
    }


def test_texts_are_read_after_they_are_spread(spark):
    texts = ('{"a\\"b":[1,{"k":[]}],"e":{},"l":[{}, "x,]{"],"":{"\\u0041":1.50}}', ' [ ] ', '"s"', "{", '{"a":1,"a":2}', None)
    frame = docs(spark, *texts).repartition(4)
    rows = C.json_leaves(frame, "id", "content", into_arrays=True)
    assert {(r.id, ".".join(r.path), r.type, r.value) for r in rows.collect()} == {
        (0, 'a"b.0', "number", "1"), (0, 'a"b.1.k', "array", "[]"), (0, "e", "object", "{}"), (0, "l.0", "object", "{}"),
        (0, "l.1", "string", "x,]{"), (0, ".A", "number", "1.5"), (1, "", "array", "[]"), (2, "", "string", "s"), (5, "", "number", None),
    }
    files = frame.select(F.concat("id", F.lit(".json")).alias("path"), "content")
    for result in (rows, R.config_risk(files), C.drift_report(files, files)):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.split("\n") if "Filter" in line and "parseJson" in line]
    # One pass, however deep: a level used to copy all that lies below it.
    plan = rows._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan
