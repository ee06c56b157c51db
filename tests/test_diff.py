import datetime as dt
import math
import random

import pytest
from pyspark.sql import Row, functions as F

from tidemark.functions.values import sql_literal
from tidemark.operators import diff as D, inventory as I, keys as K, sync as S
from tidemark.operators.edges import FkEdge
from tidemark.operators.ranking import first_per_class

SCHEMA = "id string, name string, score decimal(10,2), info string"


def frames(spark):
    src = spark.createDataFrame(
        [("a", "Same", 95.50, '{"role":"admin"}'), ("b", "New", 88.00, None), ("c", "SourceValue", 70.00, None)], "id string, name string, score double, info string"
    )
    tgt = spark.createDataFrame(
        [("a", "Same", 95.50, '{"role":"admin"}'), ("d", "Gone", 50.00, None), ("c", "TargetValue", 40.00, None)], "id string, name string, score double, info string"
    )
    cast = lambda df: df.withColumn("score", F.col("score").cast("decimal(10,2)"))
    return cast(src), cast(tgt)


def bag(df, columns=None):
    columns = sorted(columns or df.columns)
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


def test_insert_delete_update_then_apply(spark):
    src, tgt = frames(spark)
    row = D.diff_summary("t", src, tgt, ["id"]).first()
    assert (row.inserted, row.deleted, row.updated, row.source_rows, row.target_rows) == (1, 1, 1, 3, 3)
    assert row.status == "Different" and row.has_differences
    diff = D.row_diff(src, tgt, ["id"])
    for mode in ("update", "upsert"):
        applied = S.apply_changes(tgt, diff, ["id"], mode)
        assert bag(applied) == bag(src)
    assert S.verify_sync({"t": src}, {"t": S.apply_changes(tgt, diff, ["id"])}, {"t": ["id"]}).first().passed
    changes = {r.id: (r.op, r.changed_columns) for r in diff.collect()}
    assert changes == {"a": ("S", []), "b": ("I", []), "c": ("U", ["name", "score"]), "d": ("D", [])}
    update = diff.where("op = 'U'").first()
    assert update.source.name == "SourceValue" and update.target.name == "TargetValue"


def test_statements(spark):
    src, tgt = frames(spark)
    diff = D.row_diff(src, tgt, ["id"])
    text = {r.op: r.statement for r in S.render_dml(diff, "t", ["id"]).collect()}
    assert text == {
        "D": """DELETE FROM public."t" WHERE "id" = 'd';""",
        "I": """INSERT INTO public."t" ("id", "name", "score", "info") VALUES ('b', 'New', 88.00, NULL);""",
        "U": """UPDATE public."t" SET "name" = 'SourceValue', "score" = 70.00 WHERE "id" = 'c';""",
    }
    upsert = {r.op: r.statement for r in S.render_dml(diff, "t", ["id"], "prod", ["info"], upsert=True).collect()}
    assert upsert["U"] == (
        """INSERT INTO prod."t" ("id", "name", "score") VALUES ('c', 'SourceValue', 70.00) ON CONFLICT ("id") """
        """DO UPDATE SET "name" = EXCLUDED."name", "score" = EXCLUDED."score";"""
    )


def test_upsert_of_a_table_of_keys_only(spark):
    src, tgt = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(2,)], "id int")
    text = {r.op: r.statement for r in S.render_dml(D.row_diff(src, tgt, ["id"]), "t", ["id"], upsert=True).collect()}
    assert text["I"] == 'INSERT INTO public."t" ("id") VALUES (1) ON CONFLICT ("id") DO NOTHING;'


def test_null_key_in_statement(spark):
    src = spark.createDataFrame([(1, "x", 1)], "a int, b string, v int")
    tgt = spark.createDataFrame([(1, None, 1)], "a int, b string, v int")
    text = S.render_dml(D.row_diff(src, tgt, ["a", "b"]), "t", ["a", "b"]).where("op = 'D'").first().statement
    assert text == 'DELETE FROM public."t" WHERE "a" = 1 AND "b" IS NULL;'


def test_ignore_where_and_composite_key(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    src = spark.createDataFrame([(1, "TestItem", at(10))], "id int, name string, updated_at timestamp")
    tgt = spark.createDataFrame([(1, "TestItem", at(9))], "id int, name string, updated_at timestamp")
    status = lambda options: D.diff_summary("t", src, tgt, ["id"], options).first().status
    assert status(D.CompareOptions()) == "Different"
    assert status(D.CompareOptions(ignore=["UPDATED_AT"])) == "Synchronized"
    a = spark.createDataFrame([(1, 100), (2, 200)], "id int, val int")
    b = spark.createDataFrame([(1, 100), (2, 999)], "id int, val int")
    assert D.diff_summary("t", a, b, ["id"]).first().updated == 1
    assert D.diff_summary("t", a, b, ["id"], D.CompareOptions(where="id = 1")).first().status == "Synchronized"
    c = spark.createDataFrame([(1, "A", "SourceVal1"), (2, "B", "SourceVal2")], "key1 int, key2 string, val string")
    d = spark.createDataFrame([(1, "A", "SourceVal1"), (2, "B", "TargetValOld")], "key1 int, key2 string, val string")
    row = D.diff_summary("t", c, d, ["key1", "key2"]).first()
    assert (row.inserted, row.deleted, row.updated) == (0, 0, 1)
    applied = S.apply_changes(d, D.row_diff(c, d, ["key1", "key2"]), ["key1", "key2"])
    assert bag(applied) == bag(c)
    with pytest.raises(Exception):
        D.diff_summary("t", a, b, ["id"], D.CompareOptions(where="no_such_column = 1")).collect()


def test_no_key(spark):
    src, tgt = spark.createDataFrame([("Row1",)], "val string"), spark.createDataFrame([("Row2",)], "val string")
    row = D.diff_summary_all({"t": src}, {"t": tgt}, {}).first()
    assert (row.inserted, row.source_rows, row.has_differences, row.status) == (0, 0, False, "no_key")
    with pytest.raises(ValueError):
        D.row_diff(src, tgt, [])


def changed(spark, a, a_type, b, b_type, **options):
    src = spark.createDataFrame([(1, a)], f"id int, v {a_type}")
    tgt = spark.createDataFrame([(1, b)], f"id int, v {b_type}")
    return D.row_diff(src, tgt, ["id"], D.CompareOptions(**options)).first().op == "U"


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_timestamp_tolerance(spark, kind):
    base = dt.datetime(2024, 3, 10, 2, 30)
    step = lambda micros: base + dt.timedelta(microseconds=micros)
    assert not changed(spark, base, kind, step(1000), kind)
    assert changed(spark, base, kind, step(1001), kind)
    assert changed(spark, step(1001), kind, base, kind)
    assert not changed(spark, step(5000), kind, base, kind, ts_tolerance_ms=5)
    assert changed(spark, base, kind, None, kind)
    assert not changed(spark, None, kind, None, kind)


def test_value_rules(spark):
    assert not changed(spark, 1, "int", 1, "bigint")
    assert changed(spark, 1, "int", 2, "bigint")
    assert not changed(spark, 1, "int", "1", "string")
    assert not changed(spark, math.nan, "double", math.nan, "double")
    assert not changed(spark, 0.0, "double", -0.0, "double")
    assert changed(spark, "", "string", None, "string")
    assert changed(spark, [1, None], "array<int>", [1, 2], "array<int>")
    assert not changed(spark, [1, None], "array<int>", [1, None], "array<int>")
    assert not changed(spark, {"a": 1, "b": 2}, "map<string,int>", {"b": 2, "a": 1}, "map<string,int>")
    assert changed(spark, bytearray(b"a"), "binary", bytearray(b"b"), "binary")


def test_literals(spark):
    df = spark.createDataFrame(
        [(None, "it's", True, dt.datetime(2024, 1, 2, 3, 4, 5, 678901), ["a", None], bytearray(b"\x01\xff"), dt.date(2024, 1, 2), Row(k=1))],
        "n int, s string, b boolean, t timestamp, a array<string>, x binary, d date, j struct<k:int>",
    )
    row = df.select(*[sql_literal(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert row.asDict() == {
        "n": "NULL", "s": "'it''s'", "b": "TRUE", "t": "'2024-01-02 03:04:05.678'", "a": "'{a,}'",
        "x": "'\\x01ff'", "d": "'2024-01-02 00:00:00.000'", "j": """'{"k":1}'::jsonb""",
    }


def random_rows(rng, n, keys):
    return [(rng.choice(keys), rng.choice([None, "x", "y|z"]), rng.choice([None, 1, 2]), rng.choice(["p", "q", None])) for _ in range(n)]


@pytest.mark.parametrize("hot_rows", [10_000, 5])
def test_properties_with_repeated_and_null_keys(spark, hot_rows, monkeypatch):
    """Small limits send every repeated key through the split numbering."""
    monkeypatch.setattr(K.with_occurrence, "__defaults__", ((), "occurrence", None, hot_rows))
    rng = random.Random(7)
    schema = "k int, k2 string, v int, w string"
    src = spark.createDataFrame(random_rows(rng, 300, [None, 1, 1, 1, 2, 3]), schema)
    tgt = spark.createDataFrame(random_rows(rng, 260, [None, 1, 1, 2, 4]), schema)
    keys = ["k", "k2"]
    diff = D.row_diff(src, tgt, keys)
    s = D.summarize(diff).first()
    assert (s.source_rows, s.target_rows) == (300, 260)
    assert bag(S.apply_changes(tgt, diff, keys)) == bag(src)
    assert bag(S.apply_changes(tgt, diff.where("op <> 'S'"), keys, "upsert")) == bag(src)
    back = D.summarize(D.row_diff(tgt, src, keys)).first()
    assert (back.inserted, back.deleted, back.updated) == (s.deleted, s.inserted, s.updated)
    same = D.summarize(D.row_diff(src, src, keys)).first()
    assert not same.has_differences and same.source_rows == 300
    assert bag(K.inserted_keys(src, tgt, keys)) == bag(K.deleted_keys(tgt, src, keys))


def test_split_numbering_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, rng.randrange(5), "c") for _ in range(200)] + [(2, i, "d") for i in range(90)] + [(3, 1, "e"), (None, 2, None)]
    df = spark.createDataFrame(rows, "k int, v int, w string").repartition(5)
    got = sorted(map(repr, (tuple(r) for r in K.with_occurrence(df, ["k"], ["v"], hot_group_rows=7).collect())))
    want, seen = [], {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "")):
        seen[r[0]] = seen.get(r[0], 0) + 1
        want.append(repr((*r, seen[r[0]])))
    assert got == sorted(want)


def test_key_profile(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (None, "a"), (2, None)], "k int, l string")
    row = K.key_profile(df, ["k", "l"]).first()
    assert row.asDict() == dict(n_rows=5, n_keys=3, null_key_rows=2, duplicate_keys=1, excess_rows=2, largest_group=3)
    empty = K.key_profile(df.where("false"), ["k"]).first()
    assert (empty.n_rows, empty.largest_group) == (0, 0)


def test_keys_do_not_collide_as_text(spark):
    src = spark.createDataFrame([("a|b", "c"), (None, "x")], "p string, q string")
    tgt = spark.createDataFrame([("a", "b|c"), ("NULL", "x")], "p string, q string")
    row = D.diff_summary("t", src, tgt, ["p", "q"]).first()
    assert (row.inserted, row.deleted) == (2, 2)


def test_side_by_side(spark):
    src, tgt = frames(spark)
    lines = D.diff_side_by_side(D.row_diff(src, tgt, ["id"])).orderBy("line").collect()
    assert [(r.row_type, r.changed_columns, r.name, r.info) for r in lines] == [
        ("New", "name, score", "SourceValue", "NULL"), ("Old", "", "TargetValue", "NULL"),
    ]


def test_columns_of_one_side_are_no_difference(spark):
    src = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, v string, extra int")
    tgt = spark.createDataFrame([(1, "a", 7)], "id int, v string, other int")
    diff = D.row_diff(src, tgt, ["id"])
    assert {r.id: r.op for r in diff.collect()} == {1: "S", 2: "I"}
    applied = {r.id: r.other for r in S.apply_changes(tgt, diff, ["id"]).collect()}
    assert applied == {1: 7, 2: None}


def test_feed_order_and_round_trip(spark):
    parent_src = spark.createDataFrame([(1, 1.5), (3, None)], "id int, v double")
    parent_tgt = spark.createDataFrame([(1, 2.5), (2, 0.1)], "id int, v double")
    t = lambda micros: dt.datetime(2024, 1, 1, 0, 0, 0, micros)
    child_src = spark.createDataFrame([(10, 3, t(123456))], "id int, p int, at timestamp")
    child_tgt = spark.createDataFrame([(11, 2, t(1))], "id int, p int, at timestamp")
    src, tgt = {"a_child": child_src, "parent": parent_src}, {"a_child": child_tgt, "parent": parent_tgt}
    keys = {"a_child": ["id"], "parent": ["id"]}
    feed = S.change_feed(src, tgt, keys, [FkEdge("a_child", ("p",), "parent", ("id",))])
    order = [(r.table_name, r.op) for r in S.ordered_feed(feed).collect()]
    assert order == [("a_child", "D"), ("parent", "D"), ("parent", "I"), ("parent", "U"), ("a_child", "I")]
    for table in src:
        changes = S.feed_changes(feed, table, src[table], tgt[table], keys[table])
        assert bag(S.apply_changes(tgt[table], changes, keys[table])) == bag(src[table])


def test_insert_if_absent_and_find_row(spark):
    tgt = spark.createDataFrame([(1, "old")], "id int, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "id int, v string")
    assert bag(S.insert_if_absent(tgt, new, ["id"])) == bag(spark.createDataFrame([(1, "old"), (2, "a")], "id int, v string"))
    assert I.find_row(new, "id", "1").first().v == "new"
    assert I.find_row(new, "id", "01").count() == 0 and I.find_row(new, "id", "x").count() == 0


def test_first_rows_per_class(spark):
    df = spark.range(500).selectExpr("id % 3 as c", "id")
    got = sorted((r.c, r.id) for r in first_per_class(df, ["c"], ["id"], 4).collect())
    assert got == [(c, c + 3 * i) for c in range(3) for i in range(4)]


def test_summary_reads_only_what_it_compares(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    options = D.CompareOptions(ignore=["o_orderdate", "o_totalprice"], where="o_orderstatus = 'F'", unique_keys=True)
    plan = D.diff_summary("t", orders, orders, ["o_orderkey"], options)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in plan and "o_totalprice" not in plan
    assert "EqualTo(o_orderstatus,F)" in plan and "Window" not in plan
