"""Schema and object drift over catalogs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import Registry
from queries.frames import load, with_frames
from tidemark.functions.types import display_type, normalize_type
from tidemark.operators import alignment as A, catalog as C, objects as O, risk as R
from tidemark.session import checkpointed

registry = Registry()

FIELDS = "database, schema, table_name, ordinal, column_name, data_type, char_len, num_precision, num_scale, is_nullable, column_default"


def _sides(spark, sf_dir):
    src, tgt = load(spark, sf_dir, "catalog_export", "old_catalog_export")
    return C.catalog_from_export(src), C.catalog_from_export(tgt)


_BOTH = with_frames("catalog", "old_catalog")


def norm(c: str) -> str:
    return f"""CASE lower(trim({c})) WHEN 'varchar' THEN 'character varying' WHEN 'int4' THEN 'integer' WHEN 'int' THEN 'integer'
 WHEN 'int8' THEN 'bigint' WHEN 'bool' THEN 'boolean' WHEN 'timestamp' THEN 'timestamp without time zone' WHEN 'decimal' THEN 'numeric'
 ELSE lower(trim({c})) END"""


def type_text(p: str = "") -> str:
    name = f"""CASE lower(trim({p}data_type)) WHEN 'varchar' THEN 'character varying' WHEN 'int4' THEN 'integer' WHEN 'int8' THEN 'bigint'
 WHEN 'bool' THEN 'boolean' WHEN 'timestamp' THEN 'timestamp without time zone' ELSE {p}data_type END"""
    return f"""({name}) || CASE WHEN {p}char_len IS NOT NULL THEN '(' || {p}char_len || ')'
 WHEN {p}num_precision IS NOT NULL AND {norm(p + 'data_type')} = 'numeric' THEN
      '(' || {p}num_precision || coalesce(',' || {p}num_scale, '') || ')' ELSE '' END"""


@registry.add("catalog_from_export", f"{with_frames('catalog')}\nSELECT {FIELDS} FROM catalog")
def catalog_from_export(spark, sf_dir):
    return _sides(spark, sf_dir)[0]


@registry.add(
    "normalize_type",
    f"""{with_frames('old_catalog')}
SELECT database, column_name, {norm('data_type')} AS normalized, CASE lower(trim(data_type)) WHEN 'varchar' THEN 'character varying'
  WHEN 'int4' THEN 'integer' WHEN 'int8' THEN 'bigint' ELSE data_type END AS shown FROM old_catalog""",
)
def normalize_type_query(spark, sf_dir):
    _, tgt = _sides(spark, sf_dir)
    return tgt.select(
        "database", "column_name", normalize_type(F.col("data_type")).alias("normalized"), display_type(F.col("data_type")).alias("shown")
    )


@registry.add("type_string", f"{with_frames('catalog')}\nSELECT database, column_name, {type_text()} AS type FROM catalog")
def type_string(spark, sf_dir):
    src, _ = _sides(spark, sf_dir)
    return src.select("database", "column_name", C.column_type().alias("type"))


_TABLES = """
t AS (SELECT database, schema, table_name, CASE WHEN max(t) = 0 THEN 'Added' WHEN max(s) = 0 THEN 'ExistingInTarget' ELSE 'Common' END AS diff_type
      FROM (SELECT database, schema, table_name, 1 AS s, 0 AS t FROM catalog UNION ALL SELECT database, schema, table_name, 0, 1 FROM old_catalog)
      GROUP BY ALL)"""


@registry.add("table_diff", f"{_BOTH},{_TABLES}\nSELECT * FROM t")
def table_diff(spark, sf_dir):
    return C.table_diff(*_sides(spark, sf_dir))


_COLUMNS = f"""{_TABLES},
j AS (SELECT coalesce(s.database, o.database) AS database, coalesce(s.schema, o.schema) AS schema, coalesce(s.table_name, o.table_name) AS table_name,
        coalesce(s.column_name, o.column_name) AS column_name, s.is_nullable AS new_nullable, s.column_default AS new_default,
        o.is_nullable AS old_nullable, o.column_default AS old_default,
        s.column_name IS NULL AS gone, o.column_name IS NULL AS fresh,
        CASE WHEN s.column_name IS NOT NULL THEN {type_text('s.')} END AS new_type, CASE WHEN o.column_name IS NOT NULL THEN {type_text('o.')} END AS old_type,
        {norm('s.data_type')} <> {norm('o.data_type')} OR s.char_len IS DISTINCT FROM o.char_len
          OR s.num_precision IS DISTINCT FROM o.num_precision OR s.num_scale IS DISTINCT FROM o.num_scale AS type_changed
      FROM catalog s FULL OUTER JOIN old_catalog o ON s.database = o.database AND s.schema = o.schema AND s.table_name = o.table_name AND s.column_name = o.column_name
      WHERE (coalesce(s.database, o.database), coalesce(s.schema, o.schema), coalesce(s.table_name, o.table_name)) IN
            (SELECT (database, schema, table_name) FROM t WHERE diff_type = 'Common')),
changes AS (
  SELECT *, 1 AS position, 'ADD' AS change, NULL AS old_value, new_type AS new_value FROM j WHERE fresh
  UNION ALL SELECT *, 2, 'DROP', old_type, NULL FROM j WHERE gone
  UNION ALL SELECT *, 3, 'TYPE', old_type, new_type FROM j WHERE NOT fresh AND NOT gone AND type_changed
  UNION ALL SELECT *, 4, CASE WHEN new_nullable THEN 'DROP NOT NULL' ELSE 'SET NOT NULL' END, CAST(old_nullable AS VARCHAR), CAST(new_nullable AS VARCHAR)
            FROM j WHERE NOT fresh AND NOT gone AND new_nullable <> old_nullable
  UNION ALL SELECT *, 5, CASE WHEN coalesce(new_default, '') = '' THEN 'DROP DEFAULT' ELSE 'SET DEFAULT' END, old_default, new_default
            FROM j WHERE NOT fresh AND NOT gone AND coalesce(new_default, '') <> coalesce(old_default, ''))"""


@registry.add(
    "column_diff",
    f"""{_BOTH},{_COLUMNS}
SELECT database, schema, table_name, column_name, new_nullable, new_default, position, change, old_value, new_value FROM changes""",
)
def column_diff(spark, sf_dir):
    return C.column_diff(*_sides(spark, sf_dir))


_DDL = f"""
k AS (SELECT database, schema, table_name, string_agg(key_column, ', ' ORDER BY key_position) AS cols FROM catalog_keys GROUP BY ALL),
ddl AS (SELECT c.database, c.schema, c.table_name, 'CREATE TABLE public."' || c.table_name || '" (' || chr(10) ||
   string_agg('    ' || column_name || ' ' || {type_text('c.')} || CASE WHEN coalesce(column_default, '') <> '' THEN ' DEFAULT ' || column_default ELSE '' END
              || CASE WHEN is_nullable THEN ' NULL' ELSE ' NOT NULL' END, ',' || chr(10) ORDER BY ordinal, column_name)
   || coalesce(',' || chr(10) || '    CONSTRAINT pk_' || lower(c.table_name) || ' PRIMARY KEY (' || any_value(cols) || ')', '') || chr(10) || ');' AS ddl
 FROM catalog c LEFT JOIN k ON c.database = k.database AND c.schema = k.schema AND c.table_name = k.table_name
 GROUP BY c.database, c.schema, c.table_name)"""


@registry.add("render_table_ddl", f"{with_frames('catalog', 'catalog_keys')},{_DDL}\nSELECT * FROM ddl")
def render_table_ddl(spark, sf_dir):
    src, _ = _sides(spark, sf_dir)
    (keys,) = load(spark, sf_dir, "catalog_keys")
    return C.render_table_ddl(src, keys)


def _object_rows(schema: str, src_schema: str | None = None) -> str:
    """What differs between the objects, extensions apart, as x."""
    definition = "definition"
    if src_schema:
        definition = f"CASE WHEN kind IN ('View', 'Routine', 'Materialized View') THEN replace(definition, '{src_schema}.', '{schema}.') ELSE definition END"
    return f"""
n AS (SELECT database, kind, name, CASE WHEN kind IN ('Constraint', 'Trigger') THEN coalesce(parent, '') ELSE '' END AS tab, CASE kind WHEN 'Role' THEN '' ELSE coalesce(schema, '') END AS sch,
        {definition} AS def, owner FROM objects WHERE kind <> 'Extension'),
o AS (SELECT database, kind, name, CASE WHEN kind IN ('Constraint', 'Trigger') THEN coalesce(parent, '') ELSE '' END AS tab, CASE kind WHEN 'Role' THEN '' ELSE coalesce(schema, '') END AS sch, definition AS def, owner FROM old_objects WHERE kind <> 'Extension'),
b AS (SELECT coalesce(n.database, o.database) AS database, coalesce(n.kind, o.kind) AS kind, coalesce(n.name, o.name) AS name, coalesce(n.tab, o.tab) AS tab,
        n.def AS nd, o.def AS od, n.owner AS nown, o.owner AS oown, o.name IS NULL AS added, n.name IS NULL AS removed
      FROM n FULL OUTER JOIN o ON n.database = o.database AND n.kind = o.kind AND n.name = o.name AND n.tab = o.tab AND n.sch = o.sch),
w AS (SELECT *, CASE WHEN (added OR nown <> oown) AND nown IS NOT NULL THEN CASE kind
          WHEN 'View' THEN chr(10) || 'ALTER VIEW IF EXISTS {schema}."' || name || '" OWNER TO "' || nown || '";'
          WHEN 'Materialized View' THEN chr(10) || 'ALTER TABLE IF EXISTS {schema}."' || name || '" OWNER TO "' || nown || '";'
          WHEN 'Sequence' THEN chr(10) || 'ALTER SEQUENCE IF EXISTS {schema}."' || name || '" OWNER TO "' || nown || '";'
          WHEN 'Routine' THEN chr(10) || 'ALTER FUNCTION {schema}.' || name || ' OWNER TO "' || nown || '";' ELSE '' END ELSE '' END AS own FROM b),
x AS (SELECT database, kind, CASE WHEN tab <> '' AND kind = 'Constraint' THEN name || ' [' || tab || ']' ELSE name END AS object_name, od,
    CASE WHEN added THEN 'Added' WHEN removed THEN 'ExistingInTarget' ELSE 'Altered' END AS diff_type,
    CASE WHEN added THEN nd || own WHEN removed THEN od ELSE nd END AS source_ddl,
    CASE WHEN added THEN CASE WHEN kind IN ('Role', 'Enum') THEN '-- N/A' ELSE '-- Object does not exist in Target database' END
         WHEN removed THEN '-- N/A' ELSE od END AS target_ddl,
    CASE WHEN added THEN nd || own
         WHEN removed THEN CASE kind WHEN 'Index' THEN 'DROP INDEX IF EXISTS {schema}."' || name || '";'
              WHEN 'Sequence' THEN 'DROP SEQUENCE IF EXISTS {schema}."' || name || '" CASCADE;'
              WHEN 'View' THEN 'DROP VIEW IF EXISTS {schema}.' || name || ';' WHEN 'Routine' THEN 'DROP FUNCTION IF EXISTS {schema}.' || name || ';'
              WHEN 'Materialized View' THEN 'DROP MATERIALIZED VIEW IF EXISTS {schema}.' || name || ';'
              WHEN 'Trigger' THEN 'DROP TRIGGER IF EXISTS "' || name || '" ON ' || regexp_extract(od, '(?i)\\bON\\s+(\\S+)', 1) || ';'
              WHEN 'Constraint' THEN 'ALTER TABLE ' || regexp_extract(od, '(?i)ALTER TABLE\\s+(\\S+)\\s+ADD CONSTRAINT', 1) || ' DROP CONSTRAINT IF EXISTS "' || name || '";' END
         WHEN kind = 'View' THEN 'CREATE OR REPLACE VIEW {schema}.' || name || ' AS ' || nd || own
         WHEN kind = 'Materialized View' THEN 'DROP MATERIALIZED VIEW IF EXISTS {schema}.' || name || ';' || chr(10) || nd || own
         ELSE nd || own END AS diff_script
  FROM w WHERE added OR (kind NOT IN ('Role', 'Enum') AND (removed OR nd IS DISTINCT FROM od OR coalesce(nown <> oown, false))))"""


_OBJECTS = with_frames("objects", "old_objects") + "," + _object_rows("prod", "dev")


def _object_diff(spark, sf_dir):
    src, tgt = load(spark, sf_dir, "objects", "old_objects")
    return O.object_diff(src, tgt, src_schema="dev", tgt_schema="prod", include_owner=True)


@registry.add(
    "object_diff", f"{_OBJECTS}\nSELECT database, kind, object_name, diff_type, source_ddl, target_ddl, diff_script FROM x"
)
def object_diff(spark, sf_dir):
    return _object_diff(spark, sf_dir)


@registry.add(
    "extension_diff",
    f"""{with_frames("objects", "old_objects")},
n AS (SELECT database, name, definition AS v FROM objects WHERE kind = 'Extension'), o AS (SELECT database, name, definition AS v FROM old_objects WHERE kind = 'Extension')
SELECT database, 'Extension' AS kind, name AS object_name, CASE WHEN o.v IS NULL THEN 'Added' ELSE 'Altered' END AS diff_type,
  CASE WHEN o.v IS NULL THEN 'CREATE EXTENSION IF NOT EXISTS "' || name || '" VERSION ''' || n.v || ''';' ELSE 'VERSION ''' || n.v || '''' END AS source_ddl,
  CASE WHEN o.v IS NULL THEN '-- N/A' ELSE 'VERSION ''' || o.v || '''' END AS target_ddl,
  CASE WHEN o.v IS NULL THEN 'CREATE EXTENSION IF NOT EXISTS "' || name || '" VERSION ''' || n.v || ''';' ELSE 'ALTER EXTENSION "' || name || '" UPDATE TO ''' || n.v || ''';' END AS diff_script
FROM n LEFT JOIN o USING (database, name) WHERE o.v IS DISTINCT FROM n.v""",
)
def extension_diff(spark, sf_dir):
    src, tgt = load(spark, sf_dir, "objects", "old_objects")
    return O.object_diff(src, tgt, ignore_extension=False).where("kind = 'Extension'")


_PARENT = """lower(regexp_extract(od, CASE kind WHEN 'Constraint' THEN '(?i)ALTER TABLE\\s+(?:[a-zA-Z0-9_"\\.]+\\.)?"?([a-zA-Z0-9_]+)\\b'
                                           ELSE '(?i)\\bON\\s+(?:[a-zA-Z0-9_"\\.]+\\.)?"?([a-zA-Z0-9_]+)\\b' END, 1))"""

_SUPPRESSED = f"""{_OBJECTS},
d AS (SELECT database, lower(table_name) AS tab FROM ({with_frames("dropped_tables")} SELECT * FROM dropped_tables)),
y AS (SELECT * FROM x WHERE NOT (diff_type = 'ExistingInTarget' AND kind IN ('Index', 'Trigger', 'Constraint') AND
  (database, {_PARENT}) IN (SELECT (database, tab) FROM d)))"""


@registry.add("suppress_dependents", f"{_SUPPRESSED}\nSELECT database, kind, object_name, diff_type, source_ddl, target_ddl, diff_script FROM y")
def suppress_dependents(spark, sf_dir):
    (dropped,) = load(spark, sf_dir, "dropped_tables")
    return O.suppress_dependents(_object_diff(spark, sf_dir), dropped)


@registry.add(
    "owner_diff",
    f"""{with_frames("objects", "old_objects")}
SELECT database, kind, name, n.owner AS source_owner, o.owner AS target_owner, CASE kind
          WHEN 'View' THEN 'ALTER VIEW IF EXISTS prod."' || name || '" OWNER TO "' || n.owner || '";'
          WHEN 'Materialized View' THEN 'ALTER TABLE IF EXISTS prod."' || name || '" OWNER TO "' || n.owner || '";'
          WHEN 'Sequence' THEN 'ALTER SEQUENCE IF EXISTS prod."' || name || '" OWNER TO "' || n.owner || '";'
          WHEN 'Routine' THEN 'ALTER FUNCTION prod.' || name || ' OWNER TO "' || n.owner || '";' ELSE '' END AS diff_script
FROM objects n JOIN old_objects o USING (database, kind, name) WHERE n.owner <> o.owner
  AND (kind IN ('Extension', 'Role') OR coalesce(n.schema, '') = coalesce(o.schema, ''))
  AND (kind NOT IN ('Constraint', 'Trigger') OR coalesce(n.parent, '') = coalesce(o.parent, ''))""",
)
def owner_diff(spark, sf_dir):
    return O.owner_diff(*load(spark, sf_dir, "objects", "old_objects"), tgt_schema="prod")


_PLAN = (
    with_frames("catalog", "old_catalog", "catalog_keys", "catalog_fks", "objects", "old_objects").replace("WITH ", "WITH RECURSIVE ", 1)
    + "," + _COLUMNS + "," + _DDL + """,
node AS (SELECT database, table_name, diff_type FROM t WHERE diff_type <> 'Common'),
e AS (SELECT f.database, f.child, f.parent, c.diff_type FROM catalog_fks f JOIN node c ON c.database = f.database AND c.table_name = f.child
      JOIN node p ON p.database = f.database AND p.table_name = f.parent AND p.diff_type = c.diff_type),
r(database, table_name, diff_type, level) AS (
  SELECT database, table_name, diff_type, 0 FROM node WHERE (database, table_name) NOT IN (SELECT (database, child) FROM e)
  UNION ALL SELECT e.database, e.child, e.diff_type, r.level + 1 FROM r JOIN e ON e.database = r.database AND e.parent = r.table_name),
lv AS (SELECT database, table_name, max(level) AS level FROM r GROUP BY ALL),
al AS (SELECT database, table_name, CASE change WHEN 'ADD' THEN 1 WHEN 'DROP' THEN 2 ELSE 3 END AS s, column_name, position,
  'ALTER TABLE public."' || table_name || '" ' || CASE change WHEN 'ADD' THEN 'ADD COLUMN "' || column_name || '" ' || new_value || ';'
     WHEN 'DROP' THEN 'DROP COLUMN "' || column_name || '";' WHEN 'TYPE' THEN 'ALTER COLUMN "' || column_name || '" TYPE ' || new_value || ';'
     WHEN 'SET DEFAULT' THEN 'ALTER COLUMN "' || column_name || '" SET DEFAULT ' || new_value || ';'
     ELSE 'ALTER COLUMN "' || column_name || '" ' || change || ';' END AS text FROM changes),
plan AS (
  SELECT ddl.database, 5 AS kind_rank, 1 AS phase, level, 'Table' AS kind, ddl.table_name AS object_name, 'Added' AS diff_type, ddl AS diff_script
    FROM ddl JOIN t ON t.diff_type = 'Added' AND t.database = ddl.database AND t.table_name = ddl.table_name
         JOIN lv ON lv.database = ddl.database AND lv.table_name = ddl.table_name
  UNION ALL SELECT t.database, 5, 2, -level, 'Table', t.table_name, 'ExistingInTarget', 'DROP TABLE IF EXISTS public."' || t.table_name || '" CASCADE;'
    FROM t JOIN lv ON lv.database = t.database AND lv.table_name = t.table_name WHERE t.diff_type = 'ExistingInTarget'
  UNION ALL SELECT database, 5, 3, 0, 'Table', table_name, 'Altered', string_agg(text, chr(10) ORDER BY s, column_name, position) FROM al GROUP BY database, table_name)"""
)


_WHOLE_PLAN = f"""{_PLAN},{_object_rows("public")},
y AS (SELECT * FROM x WHERE NOT (diff_type = 'ExistingInTarget' AND kind IN ('Index', 'Trigger', 'Constraint') AND
  EXISTS (SELECT 1 FROM t WHERE t.diff_type = 'ExistingInTarget' AND t.database = x.database AND lower(t.table_name) = {_PARENT}))),
z AS (SELECT n.database, n.name, n.definition AS v, o.definition AS old_v, o.name IS NULL AS added, coalesce(n.owner <> o.owner, false) AS moved
      FROM (SELECT * FROM objects WHERE kind = 'Extension') n LEFT JOIN (SELECT * FROM old_objects WHERE kind = 'Extension') o ON n.database = o.database AND n.name = o.name),
whole AS (
  SELECT * FROM plan
  UNION ALL SELECT database, 0, 0, 0, 'Extension', name, CASE WHEN added THEN 'Added' ELSE 'Altered' END,
    CASE WHEN added THEN 'CREATE EXTENSION IF NOT EXISTS "' || name || '" VERSION ''' || v || ''';' ELSE 'ALTER EXTENSION "' || name || '" UPDATE TO ''' || v || ''';' END
    FROM z WHERE added OR v IS DISTINCT FROM old_v OR moved
  UNION ALL SELECT database, CASE kind WHEN 'Role' THEN 1 WHEN 'Sequence' THEN 4 WHEN 'View' THEN 6 WHEN 'Routine' THEN 7 WHEN 'Materialized View' THEN 8
    WHEN 'Index' THEN 9 WHEN 'Constraint' THEN 10 WHEN 'Trigger' THEN 11 END, 0, 0, kind, object_name, diff_type, diff_script FROM y)"""


def _plan(spark, sf_dir, *objects, **options):
    """Plan of the catalogs, and of the objects where both sides' are given."""
    src, tgt = _sides(spark, sf_dir)
    keys, fks = load(spark, sf_dir, "catalog_keys", "catalog_fks")
    return O.schema_change_plan(src, tgt, *objects, src_edges=fks, tgt_edges=fks, keys=keys, **options)


@registry.add("schema_change_plan", f"{_WHOLE_PLAN}\nSELECT * FROM whole")
def schema_change_plan(spark, sf_dir):
    """Tables and all other kinds, versions of extensions and owners too."""
    objects = load(spark, sf_dir, "objects", "old_objects")
    # Written first: sorting looks at all rows twice.
    return checkpointed(_plan(spark, sf_dir, *objects, include_owner=True, ignore_extension=False)).orderBy(*O.PLAN_ORDER)


@registry.add(
    "schema_change_plan_objects",
    f"""{_OBJECTS}
SELECT database, CASE kind WHEN 'Role' THEN 1 WHEN 'Sequence' THEN 4 WHEN 'View' THEN 6 WHEN 'Routine' THEN 7 WHEN 'Materialized View' THEN 8
    WHEN 'Index' THEN 9 WHEN 'Constraint' THEN 10 WHEN 'Trigger' THEN 11 END AS kind_rank, kind, object_name, diff_type FROM x""",
)
def schema_change_plan_objects(spark, sf_dir):
    """The object rows of a plan over catalogs and objects together."""
    src, tgt = _sides(spark, sf_dir)
    objects, old = load(spark, sf_dir, "objects", "old_objects")
    plan = O.schema_change_plan(src, tgt, objects, old, tgt_schema="prod", src_schema="dev", include_owner=True)
    return plan.where("kind <> 'Table'").select("database", "kind_rank", "kind", "object_name", "diff_type")


@registry.add(
    "schema_change_plan_owners",
    f"""{_PLAN},
own AS (SELECT database, table_name, 4 AS s, '' AS column_name, 0 AS position,
    'ALTER TABLE IF EXISTS public."' || table_name || '" OWNER TO "admin";' AS text FROM t WHERE diff_type = 'Common' AND length(table_name) % 2 = 0),
every AS (SELECT * FROM al UNION ALL SELECT * FROM own)
SELECT database, table_name AS object_name, string_agg(text, chr(10) ORDER BY s, column_name, position) AS diff_script FROM every GROUP BY database, table_name""",
)
def schema_change_plan_owners(spark, sf_dir):
    """Altered tables where some have another owner, with or without other changes."""
    src, tgt = _sides(spark, sf_dir)
    empty = F.lit(None).cast("string")

    def owners(catalog, owner):
        tables = catalog.select("database", "schema", F.col("table_name").alias("name")).distinct()
        return tables.select(
            "database", "schema", F.lit("Table").alias("kind"), "name", empty.alias("parent"), empty.alias("definition"),
            empty.alias("comment"), owner.alias("owner"),
        )

    new = owners(src, F.when(F.length("name") % 2 == 0, "admin").otherwise("app"))
    plan = O.schema_change_plan(src, tgt, new, owners(tgt, F.lit("app")), include_owner=True)
    return plan.where("diff_type = 'Altered'").select("database", "object_name", "diff_script")


@registry.add("verify_schema", f"{_PLAN}\nSELECT count(*) AS remaining, count(*) = 0 AS passed FROM plan")
def verify_schema(spark, sf_dir):
    """What is left of the tables' part of a plan."""
    return O.verify_schema(_plan(spark, sf_dir))


@registry.add(
    "schema_risk",
    f"""{_BOTH},{_COLUMNS}
SELECT database, schema, table_name, '' AS column_name, 'dropped_table' AS risk FROM t WHERE diff_type = 'ExistingInTarget'
UNION ALL SELECT database, schema, table_name, column_name, 'dropped_column' FROM changes WHERE change = 'DROP'
UNION ALL SELECT database, schema, table_name, column_name, 'not_null_without_default' FROM changes
  WHERE change = 'ADD' AND NOT new_nullable AND coalesce(new_default, '') = ''""",
)
def schema_risk(spark, sf_dir):
    src, tgt = _sides(spark, sf_dir)
    return R.schema_risk(C.table_diff(src, tgt), C.column_diff(src, tgt))


@registry.add(
    "line_diff",
    f"""{with_frames("old_documents")},
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM old_documents),
both_sides AS (SELECT doc_id, regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), ',+$', '') AS line, no AS ns, NULL AS nt FROM s
  UNION ALL SELECT doc_id, regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), ',+$', ''), NULL, no FROM o),
g AS (SELECT doc_id, line, count(ns) AS cs, count(nt) AS ct, min(ns) AS fs, min(nt) AS ft FROM both_sides GROUP BY ALL)
SELECT doc_id, line, 'added' AS change, cs - least(cs, ct) AS n_lines, fs AS first_line FROM g WHERE cs > ct
UNION ALL SELECT doc_id, line, 'removed', ct - least(cs, ct), ft FROM g WHERE ct > cs
UNION ALL SELECT doc_id, line, 'same', least(cs, ct), fs FROM g WHERE cs > 0 AND ct > 0""",
)
def line_diff(spark, sf_dir):
    return O.line_diff(*load(spark, sf_dir, "documents", "old_documents"), "doc_id", "text")


@registry.add(
    "line_alignment",
    """WITH s AS (SELECT o_custkey, o_orderpriority = '1-URGENT' AS moved, o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') AS kept, o_orderpriority <> '2-HIGH' AS there, o_orderkey FROM orders),
c AS (SELECT *, count(*) FILTER (kept) OVER w + count(*) FILTER (moved) OVER (PARTITION BY o_custkey) - count(*) FILTER (moved) OVER w AS n
      FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, greatest(max(n), count(*) FILTER (moved)) AS n_same, count(*) AS n_source, count(*) FILTER (there) AS n_target FROM c GROUP BY o_custkey""",
)
def line_alignment(spark, sf_dir):
    """One text per customer, a line per order. In the old version urgent
    orders stand last, low ones read differently and high ones are missing;
    the most lines that keep their order are those kept before some place and
    those moved behind it."""
    (orders,) = load(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    line = F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus")
    old_line = F.when(priority != "2-HIGH", F.when(priority == "5-LOW", F.concat(line, F.lit(" x"))).otherwise(line))

    def text(place, of_line):
        lines = F.array_sort(F.collect_list(F.when(of_line.isNotNull(), F.struct(place.alias("p"), "o_orderkey", of_line.alias("l")))))
        joined = F.array_join(F.transform(lines, lambda r: r["l"]), "\n")
        return orders.groupBy("o_custkey").agg(F.when(F.size(lines) > 0, joined).alias("text"))

    found = A.line_alignment(text(F.lit(0), line), text((priority == "1-URGENT").cast("int"), old_line), "o_custkey", "text")
    return found.groupBy("o_custkey").agg(
        F.count(F.when(F.col("kind") == "same", 1)).alias("n_same"), F.count("source_line").alias("n_source"), F.count("target_line").alias("n_target"),
    )
