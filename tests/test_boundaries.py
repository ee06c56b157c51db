"""Cases the test tables do not hold: filters over repeated keys, deep and
cyclic cascades, large groups, equal rows, equal names, odd JSON."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.secrets import clean_json
from tidemark.operators import cascade as C, diff as D, graph as G, inventory as I, objects as O, scan as S, sync as Y
from tidemark.operators.edges import FkEdge
from tidemark.plans.release import compare_release


def test_filter_over_repeated_keys(spark):
    schema = "k long, grp string, v string"
    tgt = spark.createDataFrame([(1, "aaa", "a0"), (1, "cmp", "old"), (2, None, "n"), (3, "cmp", "gone")], schema)
    src = spark.createDataFrame([(1, "cmp", "new"), (9, "cmp", "added"), (8, "aaa", "not seen")], schema)
    options = D.CompareOptions(where="grp = 'cmp'")
    want = Counter([(1, "aaa", "a0"), (1, "cmp", "new"), (2, None, "n"), (9, "cmp", "added")])
    diff = D.row_diff(src, tgt, ["k"], options)
    assert Counter(map(tuple, Y.apply_changes(tgt, diff, ["k"], where=options.where).collect())) == want
    release = compare_release({"t": src}, {"t": tgt}, {"t": ["k"]}, options)
    assert Counter(map(tuple, release.applied("t", tgt).collect())) == want


def _chain(spark, depth):
    tables = {f"t{i}": spark.createDataFrame([(i, i - 1)], "id long, up long") for i in range(depth)}
    edges = [FkEdge(f"t{i}", ("up",), f"t{i - 1}", ("id",)) for i in range(1, depth)]
    return tables, edges, {t: ["id"] for t in tables}


def test_cascade_goes_to_the_end(spark):
    tables, edges, keys = _chain(spark, 7)
    impact = C.cascade_impact({"t0": tables["t0"]}, edges, tables, keys)
    assert {r.child_table: r.depth for r in impact.collect()} == {f"t{i}": i for i in range(1, 7)}
    cut = C.cascade_impact({"t0": tables["t0"]}, edges, tables, keys, max_depth=2)
    assert {r.child_table: r.followed for r in cut.collect()} == {"t1": True, "t2": False}
    with pytest.raises(ValueError):
        C.cascade_delete_plan(cut, {"t0": tables["t0"]}, keys)


def test_large_groups_are_followed(spark):
    tables = {
        "p": spark.createDataFrame([(1,)], "id long"),
        "c": spark.range(501).select("id", F.lit(1).cast("long").alias("p_id")),
        "g": spark.range(501).select("id", F.col("id").alias("c_id")),
    }
    edges = [FkEdge("c", ("p_id",), "p", ("id",)), FkEdge("g", ("c_id",), "c", ("id",))]
    keys = {t: ["id"] for t in tables}
    impact = C.cascade_impact({"p": tables["p"]}, edges, tables, keys)
    plan = C.cascade_delete_plan(impact, {"p": tables["p"]}, keys)
    assert {r.table_name for r in plan.select("table_name").distinct().collect()} == {"p", "c", "g"}
    capped = C.cascade_impact({"p": tables["p"]}, edges, tables, keys, expand_cap=500)
    assert [(r.child_table, r.n_rows, r.followed) for r in capped.collect()] == [("c", 501, False)]


def test_cascade_over_a_cycle_ends(spark):
    tables = {"a": spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, up long")}
    impact = C.cascade_impact({"a": tables["a"].where("id = 1")}, [FkEdge("a", ("up",), "a", ("id",))], tables, {"a": ["id"]})
    assert {(r.depth, r.parent_key, r.n_rows) for r in impact.collect()} == {
        (1, '{"id":1}', 2), (2, '{"id":3}', 1), (3, '{"id":2}', 1)
    }


def test_dependents_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1, "c", "n") for i in range(9)] + [(9, 0, "c", "n")], "ref_id long, obj_id long, obj_class string, dep_type string")
    found = G.transitive_dependents(edges, spark.createDataFrame([(0,)], "root_id long"))
    assert {r.obj_id: r.depth for r in found.collect()} == {i: i for i in range(1, 10)}


def test_repeated_key_is_found_whole(spark):
    rows = spark.createDataFrame([("7", "a"), ("7", "b"), ("8", "c")], "k string, v string")
    assert sorted(r.v for r in I.find_row(rows, "k", "7").collect()) == ["a", "b"]


def test_equal_rows_without_key_are_records_each(spark):
    tables = {"t": spark.createDataFrame([("a test", "tmp"), ("a test", "tmp"), ("x test", "-"), ("none", "-")], "a string, b string")}
    records = S.dedupe_hits(S.scan_records(tables, {}))
    assert Counter(r.content for r in records.collect()) == Counter({"a test": 2, "x test": 1})
    assert S.hits_by_table(records).first().n_records == 3


def test_equal_names_in_schemas_and_on_tables(spark):
    schema = "database string, schema string, kind string, name string, parent string, definition string, owner string"
    rows = [("d", s, "View", "v", None, f"SELECT {s}", s) for s in ("one", "two")]
    rows += [("d", "one", "Trigger", "touch", t, f"CREATE TRIGGER touch ON {t} x", t) for t in ("t1", "t2")]
    rows += [("d", s, "Extension", "e", None, "1", "o") for s in ("one",)]
    frame = spark.createDataFrame(rows, schema)
    assert O.object_diff(frame, frame, include_owner=True, ignore_extension=False).count() == 0
    assert O.owner_diff(frame, frame).count() == 0
    moved = frame.where("schema = 'one'").withColumn("schema", F.lit("dev"))
    assert O.object_diff(moved, frame.where("schema = 'one'"), src_schema="dev", tgt_schema="one", ignore_extension=False).count() == 0


def test_clean_json_keeps_numbers(spark):
    text = '{"a": 0.12345678901234567890123, "b": [12345678901234567890.5, 1e400, -0, 7], "password": "x", "key": {"n": 1.0}}'
    rows = spark.createDataFrame([(1, text), (2, "{bad"), (3, '{"a":1,"a":2}'), (4, "[" * 100_000), (5, None), (6, "[NaN]")], "id long, t string")
    got = {r.id: r.c for r in rows.select("id", clean_json(F.col("t")).alias("c")).collect()}
    assert got[1] == '{"a":0.12345678901234567890123,"b":[12345678901234567890.5,1e400,-0,7],"password":"","key":{"n":1.0}}'
    assert all(got[i] is None for i in range(2, 7))


@pytest.mark.parametrize("chunk_lines", [3, 100_000])
def test_data_is_dropped_in_one_pass(spark, chunk_lines):
    import random

    from tidemark.operators import lines as L

    script = [
        "SELECT 1;", "INSERT INTO t VALUES (1, 'x", "COPY a FROM stdin", "z');", "SELECT 2;", "COPY b FROM stdin;", "INSERT INTO u VALUES (1", "1\tx;", "\\.",
        "SELECT 3;", "\\.", "INSERT INTO v VALUES (1);", "SELECT 4;", "COPY c FROM stdin", "never ends",
    ]
    draw = random.Random(1)
    texts = {"a": script, "b": [draw.choice(script) for _ in range(200)], "c": ["SELECT 9;"], "d": ["COPY x FROM stdin", *["1"] * 20, "\\.", "SELECT 5;"]}
    rows = [(d, i, t) for d, lines in texts.items() for i, t in enumerate(lines)]
    want = []
    for d, lines in texts.items():
        state = ""
        for i, t in enumerate(lines):
            if state == "copy":
                state = "" if t == "\\." else state
            elif state == "insert":
                state = "" if t.endswith(";") else state
            elif t.startswith("COPY"):
                state = "copy"
            elif t.startswith("INSERT"):
                state = "" if t.endswith(";") else "insert"
            else:
                want.append((d, i, t))
    got = L.drop_data(spark.createDataFrame(rows, "doc string, line_no long, line string"), "doc", chunk_lines=chunk_lines)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_states_of_very_many_chunks(spark):
    """Two lines a chunk and four chunks a run: 50,000 chunks go up eight levels and down again."""
    from tidemark.operators import lines as L

    # Every 1,000 lines a COPY block of 700 lines; the text without a name starts one that never ends.
    n = 100_000
    line = F.when(F.col("id") % 1000 == 10, "COPY a FROM stdin").when(F.col("id") % 1000 == 710, "\\.").otherwise("SELECT 1;")
    long = spark.range(n).select(F.lit("a").alias("doc"), F.col("id").alias("line_no"), line.alias("line"))
    other = spark.range(5000).select(
        F.lit(None).cast("string").alias("doc"), F.col("id").alias("line_no"),
        F.when(F.col("id") == 7, "COPY b FROM stdin").otherwise("x").alias("line"),
    )
    rows = long.unionByName(other)
    got = L.drop_data(rows, "doc", chunk_lines=2, fan=4)
    assert got.where("doc = 'a'").agg(F.count("*"), F.min("line_no"), F.max("line_no")).first()[:] == (n // 1000 * 299, 0, n - 1)
    assert got.where("doc = 'a' AND line_no % 1000 BETWEEN 10 AND 710").count() == 0
    assert sorted(r.line_no for r in got.where("doc IS NULL").collect()) == list(range(7))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert L.drop_data(rows.where("false"), "doc").count() == 0


def test_rules_see_past_comments(spark):
    from tidemark.operators import lines as L

    texts = [
        "-- Name: t; Type: ACL\nGRANT ALL ON t TO x", "/* c */ ALTER TABLE t OWNER TO x", "SELECT '-- GRANT' AS a", "DO $$ -- keep\n$$",
        "-- c\nCREATE TABLE t (a int)", "SELECT \"/*\" AS x, 'it''s -- so' -- end",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    reasons = {r.id: r.reason for r in L.rule_filter(rows, "text").collect()}
    assert reasons == {0: "Privilege statement removed", 1: "OWNER TO statement removed", 2: None, 3: None, 4: None, 5: None}
    plain = [r.p for r in rows.select(L.without_comments(F.col("text")).alias("p")).collect()]
    assert plain[2:] == [texts[2], texts[3], "\nCREATE TABLE t (a int)", "SELECT \"/*\" AS x, 'it''s -- so' "]
    from tidemark.operators.rules import SAFE_RUN_REWRITES

    new = {r.id: r.rewritten for r in L.rule_rewrite(rows, "text", chain=SAFE_RUN_REWRITES).collect()}
    assert new[4] == "-- c\nCREATE TABLE IF NOT EXISTS t (a int)"


def test_hot_keys_keep_their_values(spark):
    from tidemark.operators import keys as K

    rows = spark.createDataFrame([(1, v, i % 3) for i, v in enumerate([-0.0, 0.0, float("nan")] * 6)], "k long, v double, w int")
    rows = rows.select("k", "v", F.create_map(F.lit("w"), F.col("w")).alias("m"), F.expr("parse_json(cast(w as string))").alias("j"))
    got = K.with_occurrence(rows, ["k"], [], hot_group_rows=4).collect()
    assert sorted(r.occurrence for r in got) == list(range(1, 19))
    assert Counter(str(r.v) for r in got) == Counter({"-0.0": 6, "0.0": 6, "nan": 6})
    assert Counter(r.m["w"] for r in got) == Counter({0: 6, 1: 6, 2: 6})
