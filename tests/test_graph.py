import random

from pyspark.sql import functions as F

from tidemark.operators import cascade as C, graph as G
from tidemark.operators.edges import FkEdge, edges_from_frame, fk_edges, table_levels


def levels(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame(edges, "child string, parent string")
    return {r.node: (r.level, r.in_cycle) for r in G.topological_levels(n, e).collect()}


def test_levels(spark):
    assert levels(spark, ["child", "parent", "grandparent"], [("child", "parent"), ("parent", "grandparent")]) == {
        "grandparent": (0, False), "parent": (1, False), "child": (2, False),
    }
    assert levels(spark, ["t1", "t2", "t3"], []) == {t: (0, False) for t in ("t1", "t2", "t3")}
    assert levels(spark, ["a", "b"], [("a", "b"), ("b", "a")]) == {"a": (0, True), "b": (0, True)}


def test_levels_with_cycles_copies_and_strangers(spark):
    edges = [("a", "a"), ("b", "a"), ("b", "a"), ("c", "x"), ("x", "a"), ("d", "e"), ("e", "d"), ("f", "e"), ("f", "b")]
    assert levels(spark, ["a", "b", "c", "d", "e", "f"], edges) == {
        "a": (0, False), "b": (1, False), "c": (0, False), "d": (2, True), "e": (2, True), "f": (2, True),
    }


def test_table_levels():
    edge = lambda c, p: FkEdge(c, ("x",), p, ("y",))
    assert table_levels(["c", "p", "g"], [edge("c", "p"), edge("p", "g"), edge("g", "g"), edge("p", "other")]) == {"g": 0, "p": 1, "c": 2}
    assert table_levels(["a", "b", "r"], [edge("a", "b"), edge("b", "a")]) == {"r": 0, "a": 1, "b": 1}


def test_dependents(spark):
    rows = [(1, 2, "c", "n"), (2, 3, "c", "a"), (3, 1, "c", "n"), (3, 4, "p", "n"), (2, 5, "c", "i"), (4, 6, "c", "n"), (1, 3, "c", "n")]
    edges = spark.createDataFrame(rows, "ref_id bigint, obj_id bigint, obj_class string, dep_type string")
    roots = spark.createDataFrame([(1,), (9,)], "root_id bigint")
    reach = lambda d: {(r.root_id, r.obj_id, r.depth) for r in G.transitive_dependents(edges, roots, d).collect()}
    assert reach(5) == {(1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 6, 3)}
    assert reach(1) == {(1, 2, 1), (1, 3, 1)}
    assert G.transitive_dependents(edges, roots.where("root_id = 9")).count() == 0


def test_edges_from_constraints(spark):
    rows = [
        ("db", "fk1", 2, "c", "b", "p", "y"), ("db", "fk1", 1, "c", "a", "p", "x"),
        ("db", "fk2", 1, "c", "a", "p", "x"), ("db", "fk2", 2, "c", "b", "p", "y"), ("db", "fk3", 1, "c", "z", "q", "id"),
    ]
    frame = spark.createDataFrame(rows, "database string, constraint_name string, position int, child string, child_col string, parent string, parent_col string")
    found = edges_from_frame(fk_edges(frame).where("database = 'db'"))
    assert sorted(found, key=lambda e: e.parent) == [FkEdge("c", ("a", "b"), "p", ("x", "y")), FkEdge("c", ("z",), "q", ("id",))]


def shop(spark):
    """Two ways from a to c, a two-column key, and rows without parent."""
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (3,)], "id int"),
        "b": spark.createDataFrame([(10, 1, 1), (11, 1, None), (12, 2, 1), (13, None, 2)], "id int, a1 int, a2 int"),
        "c": spark.createDataFrame([(100, 10, 1), (101, 10, 1), (102, 12, 2), (103, 11, None)], "id int, b int, a1 int"),
    }
    edges = [
        FkEdge("b", ("a1",), "a", ("id",)), FkEdge("b", ("a2",), "a", ("id",)),
        FkEdge("c", ("b", "a1"), "b", ("id", "a1")),
    ]
    return tables, edges, {"a": ["id"], "b": ["id"], "c": ["id"]}


def test_cascade_counts_paths(spark):
    tables, edges, keys = shop(spark)
    impact = C.cascade_impact({"a": tables["a"]}, edges, tables, keys, expand_cap=None)
    rows = {(r.root_key, r.depth, r.parent_key, r.child_table, r.fk_cols): (r.n_rows, r.n_paths) for r in impact.collect()}
    assert rows == {
        ('{"id":1}', 1, '{"id":1}', "b", "a1"): (2, 1), ('{"id":1}', 1, '{"id":1}', "b", "a2"): (2, 1),
        ('{"id":2}', 1, '{"id":2}', "b", "a1"): (1, 1), ('{"id":2}', 1, '{"id":2}', "b", "a2"): (1, 1),
        ('{"id":1}', 2, '{"id":10}', "c", "b,a1"): (2, 2), ('{"id":1}', 2, '{"id":12}', "c", "b,a1"): (1, 1),
        ('{"id":2}', 2, '{"id":12}', "c", "b,a1"): (1, 1),
    }
    rollup = {r.root_key: (r.affected_tables, r.affected_rows, r.total_rows, r.cascade) for r in C.cascade_rollup(impact).collect()}
    assert rollup == {'{"id":1}': (2, 4, 9, "2t × 4r"), '{"id":2}': (2, 2, 3, "2t × 2r")}
    plan = C.cascade_delete_plan(impact, {"a": tables["a"].where("id = 1")}, keys)
    steps = [(r.step, r.statement) for r in plan.where("root_key = '{\"id\":1}'").orderBy("step", "statement").collect()]
    assert steps[0] == (-2, 'DELETE FROM public."c" WHERE "b" = 10 AND "a1" = 1;')
    assert steps[-1] == (0, 'DELETE FROM public."a" WHERE "id" = 1;')


def test_cascade_depth_and_cap(spark):
    tables, edges, keys = shop(spark)
    depth = lambda **o: {r.depth for r in C.cascade_impact({"a": tables["a"]}, edges, tables, keys, **o).collect()}
    assert depth(max_depth=1) == {1} and depth(expand_cap=500) == {1, 2}
    capped = C.cascade_impact({"a": tables["a"]}, edges, tables, keys, expand_cap=1)
    assert {r.root_key for r in capped.where("depth = 2").collect()} == {'{"id":2}'}
    assert capped.where("depth = 1").count() == 4


def test_purge(spark):
    tables, edges, keys = shop(spark)
    gone = C.cascade_rows({"a": tables["a"].where("id = 2")}, edges, tables, keys)
    left = C.purge(tables, gone, keys)
    ids = {t: sorted(r.id for r in df.collect()) for t, df in left.items()}
    assert ids == {"a": [1, 3], "b": [10, 11], "c": [100, 101, 103]}
    no_key = {k: v for k, v in keys.items() if k != "c"}
    left = C.purge(tables, C.cascade_rows({"a": tables["a"].where("id = 2")}, edges, tables, no_key), no_key)
    assert sorted(r.id for r in left["c"].collect()) == [100, 101, 103]


def test_purge_of_tables_that_refer_to_themselves(spark):
    rng = random.Random(5)
    boss = {i: rng.choice([None, *range(30)]) for i in range(30)}
    staff = spark.createDataFrame(list(boss.items()), "id int, boss int")
    edges = [FkEdge("staff", ("boss",), "staff", ("id",))]
    found = C.cascade_rows({"staff": staff.where("id < 3")}, edges, {"staff": staff}, {"staff": ["id"]})["staff"]
    want = {0, 1, 2}
    while True:
        more = want | {i for i, b in boss.items() if b in want}
        if more == want:
            break
        want = more
    assert {r.id for r in found.collect()} == want and found.count() == len(want)


def test_children_limit(spark):
    tables, edges, keys = shop(spark)
    rows = C.fk_children(tables["a"], edges[0], tables, keys, limit=1).collect()
    assert sorted(r.id for r in rows) == [10, 12]
    assert C.fk_children(tables["a"].where(F.col("id") == 3), edges[0], tables, keys).count() == 0


def test_cascade_with_column_names_of_its_own(spark):
    """Tables may have columns called like those of the impact."""
    tables = {
        "p": spark.createDataFrame([(1, 5)], "root_key int, n_rows int"),
        "c": spark.createDataFrame([(7, 1), (8, 1)], "row_key int, root_key int"),
        "g": spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "n_paths int, depth int"),
    }
    edges = [FkEdge("c", ("root_key",), "p", ("root_key",)), FkEdge("g", ("depth",), "c", ("row_key",))]
    impact = C.cascade_impact({"p": tables["p"]}, edges, tables, {"p": ["root_key"], "c": ["row_key"], "g": ["n_paths"]})
    assert sorted((r.depth, r.child_table, r.n_rows, r.predicate) for r in impact.collect()) == [
        (1, "c", 2, '"root_key" = 1'), (2, "g", 1, '"depth" = 8'), (2, "g", 2, '"depth" = 7'),
    ]


def test_few_rows_do_not_move_their_children(spark):
    """A child table is read by the keys of the frontier, once for all its foreign keys."""
    parents = spark.range(3).select(F.col("id").alias("k"))
    others = spark.range(2).select(F.col("id").cast("string").alias("name"))
    child = spark.range(1000).select("id", (F.col("id") % 5).alias("k"), F.when(F.col("id") < 10, (F.col("id") % 4).cast("int")).alias("other"))
    edges = [FkEdge("c", ("k",), "p", ("k",)), FkEdge("c", ("other",), "o", ("name",))]
    tables, keys = {"p": parents, "o": others, "c": child}, {"p": ["k"], "o": ["name"], "c": ["id"]}
    roots = {"p": parents, "o": others}
    started = {t: C._start(t, rows, edges, keys, tables) for t, rows in roots.items()}
    plan = C._met("c", edges, started, tables, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan
    got = {(r.root_table, r.parent_key): r.n_rows for r in C.cascade_impact(roots, edges, tables, keys).collect()}
    assert got == {("p", f'{{"k":{i}}}'): 200 for i in range(3)} | {("o", f'{{"name":"{i}"}}'): 3 for i in range(2)}


def test_levels_are_one_scan(spark):
    """The plan does not grow with the depth of the graph."""
    for n in (3, 12):
        nodes = spark.range(n).select(F.col("id").alias("node"))
        edges = spark.range(n - 1).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
        levels = G.topological_levels(nodes, edges)
        assert [tuple(r) for r in levels.orderBy("node").collect()] == [(i, i, False) for i in range(n)]
        assert levels._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    assert G.topological_levels(nodes.where("false"), edges).count() == 0


def test_only_parents_take_part_in_the_rounds(spark, tmp_path, monkeypatch):
    """Rounds write parents that still wait; children without children are ranked at the end."""
    monkeypatch.setattr(G, "new_folder", lambda session: str(tmp_path / "rounds"))
    nodes = spark.range(100).select(F.col("id").alias("node"))
    edges = spark.range(1, 100).select(F.col("id").alias("child"), F.when(F.col("id") == 1, 0).otherwise(1).cast("long").alias("parent"))
    levels = {r.node: r.level for r in G.topological_levels(nodes, edges).collect()}
    assert levels == {0: 0, 1: 1, **{i: 2 for i in range(2, 100)}}
    assert {r.node for r in spark.read.parquet(str(tmp_path / "rounds")).collect()} == {0, 1}
