import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import any_keyword, first_keyword, keyword_test, keywords_found, occurrences, preview
from tidemark.operators import junk as J, scan as S
from tidemark.operators.edges import FkEdge
from tidemark.plans.junk_report import junk_report


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, keyword, hit",
    [
        ("dev_table", "dev", True), ("stddev_func_table", "dev", False), ("my-DEV", "dev", True), ("dev1", "dev", False),
        ("a.b", "a.b", True), ("axb", "a.b", False), ("x (c++) y", "c++", True), ("tmp\n", "tmp", True), ("é tmpé", "tmp", True),
    ],
)
def test_tokens(spark, text, keyword, hit):
    assert one(spark, text, lambda c: keyword_test(c, keyword)) is hit


def test_substrings_take_no_wildcards(spark):
    assert one(spark, "50% off_x", lambda c: keyword_test(c, "% OFF_", "substring"))
    assert not one(spark, "50 off", lambda c: keyword_test(c, "%", "substring"))


def test_first_keyword_goes_by_list_order(spark):
    assert one(spark, "tmp of test", lambda c: first_keyword(c, ["", " test ", "tmp"])) == "test"
    assert one(spark, "nothing", lambda c: first_keyword(c, ["test"])) is None
    assert one(spark, "x", lambda c: first_keyword(c, [" "])) is None


def test_occurrences_and_preview(spark):
    assert one(spark, "aAaAa", lambda c: occurrences(c, "aa")) == 2
    assert one(spark, None, lambda c: occurrences(c, "aa")) == 0
    assert one(spark, "a.b axb", lambda c: occurrences(c, "a.b")) == 1
    assert one(spark, "x" * 160, preview) == "x" * 160
    assert one(spark, "a\r\nb" + "x" * 200, preview) == "a b" + "x" * 154 + "…"


OBJECTS = "database string, schema string, kind string, name string, parent string, definition string, comment string"
COLUMNS = "database string, schema string, table_name string, ordinal int, column_name string"


def scan(spark, objects, columns, keywords, scopes=None):
    found = J.scan_catalog(spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(columns, COLUMNS), keywords, scopes)
    return found, {(r.kind, r.name): r.reason for r in found.collect()}


def test_catalog_scan(spark):
    objects = [
        ("d", "public", "Table", "dev_table", None, None, None), ("d", "public", "Table", "stddev_func_table", None, None, None),
        ("d", "public", "Table", "pg_dev", None, None, None), ("d", "public", "Table", "TableA", None, None, None),
        ("d", "public", "Table", "tablea", None, None, None), ("d", "public", "View", "v", None, "select dev", "dev"),
        ("d", "public", "Routine", "f", None, "select 1", "for dev"), ("d", "", "Role", "dev_user", None, None, None),
        ("d", "", "Schema", "dev", None, None, None), ("d", "dev", "Table", "dev_inside", None, None, None),
        ("e", "dev", "Table", "dev_elsewhere", None, None, None), ("d", "public", "View", "TableX", None, None, None),
    ]
    columns = [
        ("d", "public", "TableA", 1, "normal_col"), ("d", "public", "tablea", 2, "dev_col2"),
        ("d", "public", "tablea", 1, "dev_col1"), ("d", "public", "TableX", 1, "dev"),
    ]
    found, reasons = scan(spark, objects, columns, ["dev"])
    assert reasons == {
        ("Table", "dev_table"): "Name contains junk: dev", ("Table", "tablea"): "Column 'dev_col1' contains junk: dev",
        ("View", "v"): "Source contains junk: dev", ("Routine", "f"): "Comment contains junk: dev",
        ("Role", "dev_user"): "Name contains junk: dev", ("Schema", "dev"): "Name contains junk: dev",
        ("Table", "dev_elsewhere"): "Name contains junk: dev",
    }
    plan = [(r.database, r.phase, r.statement) for r in J.cleanup_plan(found).orderBy("database", "phase", "statement").collect()]
    assert ("d", 1, 'DROP SCHEMA IF EXISTS "dev" CASCADE;') in plan
    assert ("d", 2, 'DROP TABLE IF EXISTS "public"."dev_table" CASCADE;') in plan
    assert ("d", 2, 'DROP VIEW IF EXISTS "public"."v" CASCADE;') in plan
    assert ("d", 2, 'DROP ROLE IF EXISTS "dev_user";') in plan
    assert ("e", 2, 'DROP TABLE IF EXISTS "dev"."dev_elsewhere" CASCADE;') in plan
    scopes = spark.createDataFrame([("PUBLIC", False, True), ("dev", True, False)], "schema string, include_structure boolean, include_data boolean")
    _, reasons = scan(spark, objects, columns, ["dev"], scopes)
    assert set(reasons) == {("Role", "dev_user"), ("Schema", "dev"), ("Table", "dev_elsewhere")}


def test_report(spark):
    users = spark.createDataFrame([(1, "Test user", "a test"), (2, "real", "x"), (3, "tmp", None)], "id int, name string, note string")
    orders = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id int, user_id int")
    notes = spark.createDataFrame([("test",), ("test",)], "body string")
    tables, keys = {"users": users, "orders": orders, "notes": notes}, {"users": ["id"], "orders": ["id"]}
    edges = [FkEdge("orders", ("user_id",), "users", ("id",))]
    scanned = {"users": users, "notes": notes}
    found = junk_report(scanned, keys, edges, tables, ["tmp", "test"])
    rows = {(r.table_name, r.key): (r.no_key, r.keyword, r.columns, r.cascade) for r in found.report.collect()}
    assert rows == {
        ("users", '{"id":1}'): (False, "test", "name, note", "1t × 2r"), ("users", '{"id":3}'): (False, "tmp", "name", "— none"),
        ("notes", '{"body":"test"}'): (True, "test", "body", "— none"),
    }
    hits = S.scan_records(scanned, keys, ["tmp", "test"])
    assert hits.count() == 5 and S.scan_records(scanned, keys, ["test"], cap=1).count() == 3
    numbers = spark.createDataFrame([(1,)], "id int")
    assert S.scan_records({"n": numbers}, {"n": ["id"]}).count() == 0


WORDS = ["test", "Testing", "est", "", "te", "a.b", "a", "TEST", "c++", "a b", "é", "É x", "123", "(", "tes t"]
TEXTS = [
    "testing", "TESTING est", "a.b", "axb a b", "c++", "éÉ x", "É X", "é x", "tes test", "te-st tes t", "1234 123", "((", "", None, "\n test\n", "aa b", "a ba.b", "K\u212a test\u212a",
]


@pytest.mark.parametrize("match", ["token", "substring"])
def test_all_keywords_in_one_pass(spark, match):
    """The same as one test per keyword, also where keywords overlap."""
    words = [w for w in WORDS if w]
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(
        "t", keywords_found(F.col("t"), WORDS, match).alias("got"), any_keyword(F.col("t"), WORDS, match).alias("some"),
        F.array(*[F.coalesce(keyword_test(F.col("t"), w, match), F.lit(False)) for w in words]).alias("want"),
    )
    for r in df.collect():
        assert r.got == [i for i, hit in enumerate(r.want) if hit], (r.t, r.got, r.want)
        assert r.some == any(r.want)


def test_records_need_no_shuffle(spark):
    rows = [(1, "Test user", "a test"), (2, "real", None), (3, "tmp", "estmp")]
    users = spark.createDataFrame(rows, "id int, name string, note string")
    many = [f"word{i}" for i in range(400)] + ["tmp", "test"]
    for keys in (["id"], []):
        found = S.found_records({"users": users}, {"users": keys}, many)
        want = S.dedupe_hits(S.scan_records({"users": users}, {"users": keys}, many))
        assert sorted(map(repr, found.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    twice = S.found_records({"n": users.select("note").unionAll(users.select("note"))}, {}, ["test"])
    assert twice.count() == 2
    assert S.found_records({"n": spark.range(3)}, {"n": ["id"]}, ["test"]).count() == 0
    assert S.found_records({"n": users}, {"n": ["id"]}, [" "]).count() == 0


def test_data_scope(spark):
    users = spark.createDataFrame([(1, "test")], "id int, name string")
    scopes = spark.createDataFrame([("PUBLIC", True), ("dev", False), (None, True)], "schema string, include_data boolean")
    tables, keys = {"a": users, "b": users, "c": users}, {"a": ["id"], "b": ["id"], "c": ["id"]}
    schemas = {"a": "public", "b": "Dev"}
    assert set(S.data_scope(tables, schemas, scopes)) == {"a"}
    assert [r.table_name for r in S.scan_records(tables, keys, schemas=schemas, scopes=scopes).collect()] == ["a"]
    assert S.scan_records(tables, keys, schemas={"a": "dev"}, scopes=scopes).count() == 0
    found = junk_report(tables, keys, [FkEdge("b", ("id",), "a", ("id",))], tables, ["test"], schemas=schemas, scopes=scopes)
    assert [(r.table_name, r.cascade) for r in found.report.collect()] == [("a", "1t × 1r")]


def test_one_large_schema_is_many_tasks(spark):
    """Members of a schema meet the dropped schemas in more than one task."""
    items = spark.range(2000).select(
        F.lit("d").alias("database"), F.lit("s").alias("schema"), F.when(F.col("id") == 0, "Schema").otherwise("Table").alias("kind"),
        F.when(F.col("id") == 0, "other").otherwise(F.concat(F.lit("t"), "id")).alias("name"), F.lit(None).cast("string").alias("parent"),
    )
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = J.cleanup_plan(items).where("phase = 2").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in rows) == 1999 and max(r["count"] for r in rows) < 1200
