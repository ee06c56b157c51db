from datetime import datetime

from pyspark.sql import functions as F

from queries import all_queries
from tidemark.functions.types import display_type, normalize_type, type_string
from tidemark.operators import catalog as C, objects as O


def catalog(spark, rows):
    """(table, column, type, length, precision, scale, nullable, default) rows."""
    seen, out = {}, []
    for t, *rest in rows:
        seen[t] = seen.get(t, 0) + 1
        out.append(("db", "public", t, seen[t], *rest))
    return spark.createDataFrame(out, C.CATALOG_SCHEMA)


ID = ("id", "uuid", None, None, None, False, None)


def test_type_names(spark):
    names = ["int4", "int8", "bool", "varchar", "text", " INT ", "Decimal", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(normalize_type(F.col("n")), display_type(F.col("n"))).collect()]
    assert got == [
        ("integer", "integer"), ("bigint", "bigint"), ("boolean", "boolean"), ("character varying", "character varying"),
        ("text", "text"), ("integer", " INT "), ("numeric", "Decimal"), ("", ""),
    ]
    df = spark.createDataFrame([("varchar", 10, None, None), ("numeric", None, 10, 2), ("numeric", None, 10, None), ("int4", None, 32, 0)], "n string, l int, p int, s int")
    got = [r[0] for r in df.select(type_string(F.col("n"), F.col("l"), F.col("p"), F.col("s"))).collect()]
    assert got == ["character varying(10)", "numeric(10,2)", "numeric(10)", "integer"]


def test_column_changes(spark):
    src = catalog(spark, [
        ("t", *ID), ("t", "name", "varchar", 255, None, None, False, None), ("t", "age", "int4", None, None, None, True, "18"),
        ("t", "data", "jsonb", None, None, None, True, None), ("added", *ID),
    ])
    tgt = catalog(spark, [
        ("t", *ID), ("t", "name", "character varying", 100, None, None, False, ""), ("t", "age", "integer", None, None, None, False, None),
        ("t", "old", "text", None, None, None, True, None), ("deleted", *ID),
    ])
    got = [(r.column_name, r.change, r.old_value, r.new_value) for r in C.column_diff(src, tgt).orderBy("column_name", "position").collect()]
    assert got == [
        ("age", "DROP NOT NULL", "false", "true"), ("age", "SET DEFAULT", None, "18"), ("data", "ADD", None, "jsonb"),
        ("name", "TYPE", "character varying(100)", "character varying(255)"), ("old", "DROP", "text", None),
    ]
    assert {r.table_name: r.diff_type for r in C.table_diff(src, tgt).collect()} == {"t": "Common", "added": "Added", "deleted": "ExistingInTarget"}
    keys = spark.createDataFrame([("db", "public", "added", 1, "id")], "database string, schema string, table_name string, key_position int, key_column string")
    plan = O.schema_change_plan(src, tgt, keys=keys).orderBy(*O.PLAN_ORDER).collect()
    assert [(r.object_name, r.diff_type) for r in plan] == [("added", "Added"), ("deleted", "ExistingInTarget"), ("t", "Altered")]
    assert plan[0].diff_script == 'CREATE TABLE public."added" (\n    id uuid NOT NULL,\n    CONSTRAINT pk_added PRIMARY KEY (id)\n);'
    assert plan[2].diff_script.split("\n") == [
        'ALTER TABLE public."t" ADD COLUMN "data" jsonb;', 'ALTER TABLE public."t" DROP COLUMN "old";',
        'ALTER TABLE public."t" ALTER COLUMN "age" DROP NOT NULL;', 'ALTER TABLE public."t" ALTER COLUMN "age" SET DEFAULT 18;',
        'ALTER TABLE public."t" ALTER COLUMN "name" TYPE character varying(255);',
    ]
    same = O.schema_change_plan(src, src)
    assert O.verify_schema(same).first().passed and not O.verify_schema(O.schema_change_plan(src, tgt)).first().passed


def test_plan_reads_edges_once(spark):
    src = catalog(spark, [(t, *ID) for t in ("kept", "root", "leaf")])
    tgt = catalog(spark, [(t, *ID[:5], True, None) for t in ("kept", "gone", "last")])
    read = spark.sparkContext.accumulator(0)

    def seen(value):
        read.add(1)
        return value

    rows = [("db", "leaf", "root"), ("db", "root", "kept"), ("db", "last", "gone"), ("db", "kept", "root"), ("db", "leaf", None)]
    edges = spark.createDataFrame(rows, "database string, child string, parent string").withColumn("parent", F.udf(seen, "string")("parent"))
    plan = O.schema_change_plan(src, tgt, src_edges=edges, tgt_edges=edges)
    got = sorted((r.object_name, r.diff_type, r.level) for r in plan.collect())
    assert got == [("gone", "ExistingInTarget", 0), ("kept", "Altered", 0), ("last", "ExistingInTarget", -1), ("leaf", "Added", 1), ("root", "Added", 0)]
    assert read.value <= len(rows)


def test_columns_that_stay_are_no_change(spark):
    many = spark.createDataFrame([("db", "s", "t", 1, "c", None, 1, None, None, None, None), ("db", "s", "t", 2, None, "text", None, None, None, True, None)], C.CATALOG_SCHEMA)
    # A null name has no partner: it comes and goes on either side.
    got = lambda tables: sorted((r.column_name or "", r.change) for r in C.column_diff(many, many, tables).collect())
    assert got(None) == got(C.table_diff(many, many)) == [("", "ADD"), ("", "ADD"), ("", "DROP"), ("", "DROP")]


def test_key_names_leave_out_numbered_prefixes(spark):
    rows = [("U01_Orders", *ID), ("u02_", *ID)]
    keys = spark.createDataFrame([("db", "public", t, 1, "id") for t, *_ in rows], "database string, schema string, table_name string, key_position int, key_column string")
    ddl = {r.table_name: r.ddl for r in C.render_table_ddl(catalog(spark, rows), keys).collect()}
    assert "CONSTRAINT pk_orders PRIMARY KEY" in ddl["U01_Orders"] and "CONSTRAINT pk_u02_ PRIMARY KEY" in ddl["u02_"]


OBJECTS = "database string, schema string, kind string, name string, parent string, definition string, comment string, owner string"


def objects(spark, rows):
    return spark.createDataFrame([("db", "public", k, n, p, d, None, o) for k, n, p, d, o in rows], OBJECTS)


def test_object_changes(spark):
    src = objects(spark, [
        ("View", "v", None, "select 1 from dev.t", "a"), ("View", "same", None, "select * from dev.t", "a"), ("Materialized View", "mv", None, "create mv", "a"),
        ("Routine", "f(integer)", None, "body 2", "a"), ("Enum", "e1", None, "create enum", "a"), ("Sequence", "s", None, "start 100", "a"),
        ("Constraint", "fk", "child", "ALTER TABLE public.child ADD CONSTRAINT fk", "a"), ("Extension", "x", None, "2", "a"),
    ])
    tgt = objects(spark, [
        ("View", "v", None, "select 2 from prod.t", "a"), ("View", "same", None, "select * from prod.t", "b"), ("Routine", "f(integer)", None, "body 1", "a"),
        ("Enum", "gone", None, "create enum", "a"), ("Role", "gone", None, "create role", "a"), ("Extension", "x", None, "1", "a"),
        ("Index", "i", None, 'CREATE INDEX i ON public."Dropped" (a)', "a"), ("Index", "j", None, "CREATE INDEX j ON public.kept (a)", "a"),
        ("Trigger", "tr", None, "CREATE TRIGGER tr AFTER INSERT ON public.DROPPED EXECUTE f()", "a"), ("Trigger", "odd", None, "nothing", "a"),
        ("Constraint", "fk", "other", "ALTER TABLE public.other ADD CONSTRAINT fk", "a"),
    ])
    diff = O.object_diff(src, tgt, "dev", "prod")
    got = {(r.kind, r.object_name): (r.diff_type, r.diff_script) for r in diff.collect()}
    assert got == {
        ("View", "v"): ("Altered", "CREATE OR REPLACE VIEW prod.v AS select 1 from prod.t"), ("Materialized View", "mv"): ("Added", "create mv"),
        ("Routine", "f(integer)"): ("Altered", "body 2"), ("Enum", "e1"): ("Added", "create enum"), ("Sequence", "s"): ("Added", "start 100"),
        ("Constraint", "fk [child]"): ("Added", "ALTER TABLE public.child ADD CONSTRAINT fk"),
        ("Constraint", "fk [other]"): ("ExistingInTarget", 'ALTER TABLE public.other DROP CONSTRAINT IF EXISTS "fk";'),
        ("Index", "i"): ("ExistingInTarget", 'DROP INDEX IF EXISTS prod."i";'), ("Index", "j"): ("ExistingInTarget", 'DROP INDEX IF EXISTS prod."j";'),
        ("Trigger", "tr"): ("ExistingInTarget", 'DROP TRIGGER IF EXISTS "tr" ON public.DROPPED;'),
        ("Trigger", "odd"): ("ExistingInTarget", '-- Trigger "odd" was removed from Source. Could not detect table to drop automatically.'),
    }
    dropped = spark.createDataFrame([("db", "dropped"), ("db2", "kept")], "database string, table_name string")
    left = {(r.kind, r.object_name) for r in O.suppress_dependents(diff, dropped).collect()}
    assert set(got) - left == {("Index", "i"), ("Trigger", "tr")}
    owners = O.object_diff(src, tgt, "dev", "prod", include_owner=True, ignore_extension=False)
    more = {(r.kind, r.object_name): r.diff_script for r in owners.collect()}
    assert more[("View", "same")].endswith('ALTER VIEW IF EXISTS prod."same" OWNER TO "a";')
    assert more[("Extension", "x")] == "ALTER EXTENSION \"x\" UPDATE TO '2';"
    assert [r.name for r in O.owner_diff(src, tgt).collect()] == ["same"]


def test_owners_of_tables(spark):
    rows = lambda *tables: catalog(spark, [(t, *ID) for t in tables])
    owners = lambda **o: objects(spark, [("Table", t, None, None, owner) for t, owner in o.items()])
    src, tgt = rows("kept", "moved", "new"), rows("kept", "moved", "gone")
    new, old = owners(kept="a", moved="b", new="c"), owners(kept="a", moved="a", gone="a")
    plan = lambda **o: {(r.object_name, r.diff_type): r.diff_script for r in O.schema_change_plan(src, tgt, new, old, **o).collect()}
    changed = plan(include_owner=True)
    assert changed[("moved", "Altered")] == 'ALTER TABLE IF EXISTS public."moved" OWNER TO "b";'
    assert set(changed) == {("moved", "Altered"), ("new", "Added"), ("gone", "ExistingInTarget")}
    assert ("moved", "Altered") not in plan()
    # A schema that is called otherwise on the target.
    dev = src.withColumn("schema", F.lit("dev"))
    both = O.owner_diff(new.withColumn("schema", F.lit("dev")), old, src_schema="dev")
    assert [r.name for r in both.collect()] == ["moved"] and dev.count() == 3


def test_plan_query_has_all_kinds(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    day = lambda year: datetime(year, 5, 1)
    # One table is new, one is gone; keys are texts so that objects can hang on the one that is gone.
    write("lineitem", [
        ("1", "1", "s1", 1, 5.0, 1.0, 0.01, 0.08, "N", "O", day(1998)), ("2", "1", "R_2001", 1, 5.0, 1.0, 0.01, 0.02, "R", "F", day(2001)),
    ], "l_orderkey string, l_partkey string, l_suppkey string, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    write("orders", [
        (1, "7", "O", "5-LOW"), (2, "7", "P", "5-LOW"), (3, "7", "F", "5-LOW"), (4, "7", "F", "1-URGENT"), (5, "R_2001", "F", "1-URGENT"),
        (6, "R_2001", "F", "2-HIGH"), (7, "R_2001", "F", "3-MEDIUM"), (8, "7", "F", "3-MEDIUM"), (9, "7", "O", "2-HIGH"), (10, "7", "O", "4-NOT SPECIFIED"),
        (11, "7", "F", "4-NOT SPECIFIED"),
    ], "o_orderkey bigint, o_custkey string, o_orderstatus string, o_orderpriority string")
    write("documents", [
        (1, "a", "en", "s1", 50), (2, "b", "fr", "s1", 6000), (3, "c", "de", "s1", 2500), (4, "d", "es", "s1", 1000),
    ], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write("nation", [(1, 0)], "n_nationkey int, n_regionkey int")
    rows = all_queries().spark["schema_change_plan"](spark, str(tmp_path)).collect()
    assert [(r.database, r.kind, r.object_name, r.diff_type) for r in rows] == [
        ("db_7", "Extension", "o_1", "Added"), ("db_7", "Extension", "o_2", "Altered"), ("db_7", "Role", "o_10", "Added"),
        ("db_7", "Index", "o_4", "ExistingInTarget"), ("db_7", "Constraint", "o_8 [T_7]", "ExistingInTarget"), ("db_7", "Trigger", "o_9", "Added"),
        ("db_R_2001", "Table", "t_R_2001", "ExistingInTarget"),
        ("db_n", "View", "v_1", "Altered"), ("db_n", "View", "v_1", "Altered"), ("db_n", "Trigger", "touch", "Altered"),
        ("db_s1", "Table", "t_N_1998", "Added"),
        ("s1", "Sequence", "obj_1", "ExistingInTarget"), ("s1", "View", "obj_2", "Added"), ("s1", "Routine", "obj_3", "Altered"),
        ("s1", "Materialized View", "obj_4", "Altered"),
    ]
    scripts = {(r.kind, r.object_name): r.diff_script for r in rows}
    assert scripts[("Extension", "o_2")] == "ALTER EXTENSION \"o_2\" UPDATE TO '1.7';"
    assert scripts[("Index", "o_4")] == 'DROP INDEX IF EXISTS public."o_4";'
    assert scripts[("Sequence", "obj_1")] == 'DROP SEQUENCE IF EXISTS public."obj_1" CASCADE;'
    assert scripts[("View", "obj_2")] == 'dev.b\nALTER VIEW IF EXISTS public."obj_2" OWNER TO "admin";'
    assert scripts[("Routine", "obj_3")] == 'dev.c\nALTER FUNCTION public.obj_3 OWNER TO "admin";'
    assert scripts[("Materialized View", "obj_4")] == "DROP MATERIALIZED VIEW IF EXISTS public.obj_4;\ndev.d"


def test_catalog_of_frames(spark):
    df = spark.sql("select 1 as a, 'x' as b, cast(1.5 as decimal(8,2)) as c, array(1) as d, timestamp_ntz'2024-01-01 00:00:00' as e")
    rows = C.catalog_of({"t": df}, "db").orderBy("ordinal").collect()
    assert [(r.column_name, r.data_type, r.num_precision, r.num_scale) for r in rows] == [
        ("a", "integer", None, None), ("b", "text", None, None), ("c", "numeric", 8, 2), ("d", "integer[]", None, None),
        ("e", "timestamp without time zone", None, None),
    ]


def test_line_diff(spark):
    src = spark.createDataFrame([(1, "a,\nb\nb\n\nc"), (2, "only new")], "id int, text string")
    tgt = spark.createDataFrame([(1, "  a\nb\nd"), (3, "only old")], "id int, text string")
    got = {(r.id, r.line, r.change): (r.n_lines, r.first_line) for r in O.line_diff(src, tgt, "id", "text").collect()}
    assert got == {
        (1, "a", "same"): (1, 1), (1, "b", "same"): (1, 2), (1, "b", "added"): (1, 2), (1, "", "added"): (1, 4),
        (1, "c", "added"): (1, 5), (1, "d", "removed"): (1, 3), (2, "only new", "added"): (1, 1), (3, "only old", "removed"): (1, 1),
    }
