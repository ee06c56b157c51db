"""Drift of views, routines, indexes and other objects, and the whole plan.

An object frame has the columns database, schema, kind, name, parent,
definition, comment and owner; an extension's definition is its version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import same_line
from tidemark.operators.catalog import (
    TABLE,
    alter_statement,
    column_diff,
    render_table_ddl,
    table_diff,
)
from tidemark.operators.graph import topological_levels
from tidemark.operators.junk import filled
from tidemark.operators.keys import union_all
from tidemark.session import checkpointed

# Order of kinds in a plan, kinds that only report additions,
# kinds whose text names its schema, and patterns that find a parent table.
KIND_ORDER = (
    "Extension", "Role", "Enum", "Type", "Sequence", "Table", "View", "Routine",
    "Materialized View", "Index", "Constraint", "Trigger",
)
ADDED_ONLY = ("Role", "Enum")
OF_DATABASE = ("Extension", "Role")
OF_TABLE = ("Constraint", "Trigger")
NAMES_SCHEMA = ("View", "Routine", "Materialized View")
DEPENDENT_KINDS = ("Index", "Trigger", "Constraint")
PARENT_OF_INDEX = r'(?i)\bON\s+(?:[a-zA-Z0-9_"\.]+\.)?"?([a-zA-Z0-9_]+)\b'
PARENT_OF_CONSTRAINT = r'(?i)ALTER TABLE\s+(?:[a-zA-Z0-9_"\.]+\.)?"?([a-zA-Z0-9_]+)\b'
TABLE_OF_TRIGGER = r"(?i)\bON\s+(\S+)"
TABLE_OF_CONSTRAINT = r"(?i)ALTER TABLE\s+(\S+)\s+ADD CONSTRAINT"
# Drop and owner statements by kind; {s} schema, {n} name,
# {t} table found in the definition, {o} owner.
DROPS = {
    "Index": 'DROP INDEX IF EXISTS {s}."{n}";',
    "Sequence": 'DROP SEQUENCE IF EXISTS {s}."{n}" CASCADE;',
    "Type": 'DROP TYPE IF EXISTS {s}."{n}" CASCADE;',
    "View": "DROP VIEW IF EXISTS {s}.{n};",
    "Routine": "DROP FUNCTION IF EXISTS {s}.{n};",
    "Materialized View": "DROP MATERIALIZED VIEW IF EXISTS {s}.{n};",
    "Trigger": 'DROP TRIGGER IF EXISTS "{n}" ON {t};',
    "Constraint": 'ALTER TABLE {t} DROP CONSTRAINT IF EXISTS "{n}";',
}
NO_TABLE = '-- {k} "{n}" was removed from Source. Could not detect table to drop automatically.'
OWNERS = {
    "Table": '\nALTER TABLE IF EXISTS {s}."{n}" OWNER TO "{o}";',
    "View": '\nALTER VIEW IF EXISTS {s}."{n}" OWNER TO "{o}";',
    "Materialized View": '\nALTER TABLE IF EXISTS {s}."{n}" OWNER TO "{o}";',
    "Sequence": '\nALTER SEQUENCE IF EXISTS {s}."{n}" OWNER TO "{o}";',
    "Routine": '\nALTER FUNCTION {s}.{n} OWNER TO "{o}";',
    "Type": '\nALTER TYPE {s}."{n}" OWNER TO "{o}";',
}
ABSENT = "-- Object does not exist in Target database"
NOT_APPLICABLE = "-- N/A"

RESULT = ("database", "kind", "object_name", "diff_type", "source_ddl", "target_ddl", "diff_script")


def _by_kind(templates: dict[str, str], **values: Column) -> Column:
    return F.coalesce(*[F.when(F.col("kind") == k, filled(t, **values)) for k, t in templates.items()])


def _found(pattern: str, text: Column) -> Column:
    """First group of the pattern, null where it does not match."""
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", hit)


def rewritten(definition: Column, kind: Column, src_schema: str | None, tgt_schema: str) -> Column:
    """Definition with the source schema replaced by the target schema."""
    if not src_schema:
        return definition
    moved = F.replace(definition, F.lit(src_schema + "."), F.lit(tgt_schema + "."))
    return F.when(kind.isin(*NAMES_SCHEMA), moved).otherwise(definition)


def _place(df: DataFrame, src_schema: str | None = None, tgt_schema: str = "public") -> list[Column]:
    """What tells apart objects of one name: the schema of those that stand in
    one, the source's read as the target's, and the table of what hangs on one."""
    schema = F.coalesce("schema", F.lit("")) if "schema" in df.columns else F.lit("")
    if src_schema:
        schema = F.when(schema == src_schema, tgt_schema).otherwise(schema)
    table = F.when(F.col("kind").isin(*OF_TABLE), F.coalesce("parent", F.lit(""))) if "parent" in df.columns else F.lit("")
    return [
        F.when(F.col("kind").isin(*OF_DATABASE), "").otherwise(schema).alias("in_schema"), F.coalesce(table, F.lit("")).alias("of_table"),
    ]


def object_diff(
    src: DataFrame,
    tgt: DataFrame,
    src_schema: str | None = None,
    tgt_schema: str = "public",
    include_owner: bool = False,
    ignore_extension: bool = True,
) -> DataFrame:
    """Objects that are Added, ExistingInTarget or Altered, with both texts
    and the script that follows. Altered means another definition, letter by
    letter, or with ``include_owner`` another owner. Tables are compared by
    their columns, see catalog.py."""
    kinds = [k for k in KIND_ORDER if k != "Table" and not (ignore_extension and k == "Extension")]

    def side(df: DataFrame, prefix: str, definition: Column) -> DataFrame:
        place = _place(df, src_schema if prefix == "s_" else None, tgt_schema)
        return df.where(F.col("kind").isin(*kinds)).select(
            "database", "kind", "name", *place,
            definition.alias(prefix + "def"), F.col("owner").alias(prefix + "owner"), F.lit(True).alias(prefix + "here"),
        )

    new = side(src, "s_", rewritten(F.col("definition"), F.col("kind"), src_schema, tgt_schema))
    old = side(tgt, "t_", F.col("definition"))
    both = new.join(old, ["database", "kind", "name", "in_schema", "of_table"], "full_outer")
    kind, name, schema = F.col("kind"), F.col("name"), F.lit(tgt_schema)
    added, removed = F.col("t_here").isNull(), F.col("s_here").isNull()
    owner_changed = F.lit(False)
    owner_ddl = F.lit("")
    if include_owner:
        owner_changed = F.coalesce(F.col("s_owner") != F.col("t_owner"), F.lit(False))
        text = F.coalesce(_by_kind(OWNERS, s=schema, n=name, o=F.col("s_owner")), F.lit(""))
        owner_ddl = F.when(F.col("s_owner").isNotNull() & (added | owner_changed), text).otherwise(F.lit(""))
    altered = ~added & ~removed & (~F.col("s_def").eqNullSafe(F.col("t_def")) | owner_changed)
    reported = added | (~kind.isin("Extension", *ADDED_ONLY) & removed) | (~kind.isin(*ADDED_ONLY) & altered)

    version = lambda c: F.concat(F.lit("VERSION '"), c, F.lit("'"))
    extension = kind == "Extension"
    create = F.when(
        extension, F.concat(F.lit('CREATE EXTENSION IF NOT EXISTS "'), name, F.lit('" '), version(F.col("s_def")), F.lit(";"))
    ).otherwise(F.concat("s_def", owner_ddl))
    table = (
        F.when(kind == "Trigger", _found(TABLE_OF_TRIGGER, F.col("t_def")))
        .when(kind == "Constraint", _found(TABLE_OF_CONSTRAINT, F.col("t_def")))
        .otherwise(F.lit(""))
    )
    drop = F.when(table.isNull(), filled(NO_TABLE, k=kind, n=name)).otherwise(_by_kind(DROPS, s=schema, n=name, t=table))
    change = (
        F.when(extension, F.concat(F.lit('ALTER EXTENSION "'), name, F.lit("\" UPDATE TO '"), "s_def", F.lit("';")))
        .when(kind == "View", F.concat(F.lit(f"CREATE OR REPLACE VIEW {tgt_schema}."), name, F.lit(" AS "), "s_def", owner_ddl))
        .when(
            kind == "Materialized View",
            F.concat(F.lit(f"DROP MATERIALIZED VIEW IF EXISTS {tgt_schema}."), name, F.lit(";\n"), "s_def", owner_ddl),
        )
        .otherwise(F.concat("s_def", owner_ddl))
    )
    no_target = F.when(kind.isin("Extension", *ADDED_ONLY), NOT_APPLICABLE).otherwise(ABSENT)
    shown = F.when((F.col("of_table") != "") & (kind == "Constraint"), F.concat(name, F.lit(" ["), "of_table", F.lit("]"))).otherwise(name)
    return both.where(reported).select(
        "database", "kind", shown.alias("object_name"),
        F.when(added, "Added").when(removed, "ExistingInTarget").otherwise("Altered").alias("diff_type"),
        F.when(added, create).when(removed, F.col("t_def")).when(extension, version(F.col("s_def"))).otherwise(F.col("s_def")).alias("source_ddl"),
        F.when(added, no_target).when(removed, NOT_APPLICABLE).when(extension, version(F.col("t_def"))).otherwise(F.col("t_def")).alias("target_ddl"),
        F.when(added, create).when(removed, drop).otherwise(change).alias("diff_script"),
    )


def owner_diff(
    src: DataFrame, tgt: DataFrame, tgt_schema: str = "public", src_schema: str | None = None, with_place: bool = False
) -> DataFrame:
    """Objects on both sides whose owner differs, with the ownership statement;
    ``with_place`` adds the schema they are compared in (in_schema)."""
    names = ["database", "kind", "name"]
    both = src.select(*names, *_place(src, src_schema, tgt_schema), F.col("owner").alias("source_owner")).join(
        tgt.select(*names, *_place(tgt), F.col("owner").alias("target_owner")), [*names, "in_schema", "of_table"]
    )
    text = _by_kind(OWNERS, s=F.lit(tgt_schema), n=F.col("name"), o=F.col("source_owner"))
    return both.where("source_owner <> target_owner").select(
        *names, *(["in_schema"] if with_place else []), "source_owner", "target_owner", F.ltrim(F.coalesce(text, F.lit("")), F.lit("\n")).alias("diff_script")
    )


def parent_table(kind: Column, definition: Column) -> Column:
    """Table an index, trigger or constraint definition belongs to, else null."""
    return F.when(kind.isin("Index", "Trigger"), _found(PARENT_OF_INDEX, definition)).when(
        kind == "Constraint", _found(PARENT_OF_CONSTRAINT, definition)
    )


def suppress_dependents(diff: DataFrame, dropped_tables: DataFrame) -> DataFrame:
    """The object diff without the removed indexes, triggers and constraints
    of dropped tables (database, table_name), any letter case."""
    removed = F.col("diff_type") == "ExistingInTarget"
    # Rows that hang on no table are dealt by their names, not all of a database to one task.
    near = diff.withColumn("_parent", F.when(removed, F.lower(parent_table(F.col("kind"), F.col("source_ddl"))))).withColumn(
        "_deal", F.when(F.col("_parent").isNull(), F.xxhash64("kind", "object_name")).otherwise(F.xxhash64("database", "_parent"))
    )
    dropped = dropped_tables.select(F.col("database").alias("_db"), F.lower("table_name").alias("_table")).distinct()
    dropped = dropped.withColumn("_dealt", F.xxhash64("_db", "_table"))
    gone = (F.col("database") == F.col("_db")) & (F.col("_parent") == F.col("_table")) & (F.col("_deal") == F.col("_dealt"))
    return near.join(dropped, gone, "left_anti").drop("_parent", "_deal")


def _leveled(tables: DataFrame, src_edges: DataFrame | None, tgt_edges: DataFrame | None) -> DataFrame:
    """One-sided tables of `table_diff` with their parent-first level among
    those added, or those removed, under the edges (database, child, parent)
    of their side. Both sides and all databases are ranked together."""
    sides = [(e, t) for e, t in ((src_edges, "Added"), (tgt_edges, "ExistingInTarget")) if e is not None]
    if not sides:
        return tables.withColumn("level", F.lit(0))
    node = lambda name, diff_type: F.struct(diff_type.alias("diff_type"), "database", F.col(name).alias("table_name"))
    nodes = tables.select(node("table_name", F.col("diff_type")).alias("node"))
    of_one = lambda e, *kinds: e.select("database", "child", "parent", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("diff_type")).select(
        *[node(end, F.col("diff_type")).alias(end) for end in ("child", "parent")]
    )
    # The same edges on both sides are read once.
    same = src_edges is tgt_edges
    edges = of_one(src_edges, *[t for _, t in sides]) if same else union_all([of_one(e, t) for e, t in sides])
    # Most tables are on both sides. Written, as the ranks read the edges several times.
    edges = checkpointed(edges.join(nodes.select(F.col("node").alias("child")), "child", "left_semi"))
    levels = topological_levels(nodes, edges)
    return tables.join(levels.select("node.*", "level"), ["diff_type", "database", "table_name"])


def _owner_lines(
    src_objects: DataFrame, tgt_objects: DataFrame, tables: DataFrame, tgt_schema: str, src_schema: str | None
) -> DataFrame:
    """A last line for every table on both sides that has another owner."""
    of_tables = lambda df: df.where("kind = 'Table'")
    schema = F.when(F.col("in_schema") == tgt_schema, src_schema).otherwise(F.col("in_schema")) if src_schema else F.col("in_schema")
    changed = owner_diff(of_tables(src_objects), of_tables(tgt_objects), tgt_schema, src_schema, with_place=True)
    line = F.struct(F.lit(4).alias("s"), F.lit("").alias("column_name"), F.lit(0).alias("position"), F.col("diff_script").alias("text"))
    # Catalogs name tables by the schema they stand in on their side.
    named = changed.select("database", F.array_distinct(F.array("in_schema", schema)).alias("_in"), F.col("name").alias("table_name"), line.alias("_line"))
    spread = named.select("database", F.explode("_in").alias("schema"), "table_name", "_line")
    return tables.where("diff_type = 'Common'").select(*TABLE).join(spread, list(TABLE))


def schema_change_plan(
    src_catalog: DataFrame,
    tgt_catalog: DataFrame,
    src_objects: DataFrame | None = None,
    tgt_objects: DataFrame | None = None,
    src_edges: DataFrame | None = None,
    tgt_edges: DataFrame | None = None,
    keys: DataFrame | None = None,
    tgt_schema: str = "public",
    **object_options,
) -> DataFrame:
    """All drift in the order it is to be run: kinds in their fixed order,
    tables as added (parents first), removed (children first) and altered.
    With ``include_owner`` the Table rows of the objects give the owners of
    tables: another owner alters a table, as its last statement.

    The order is in the columns `PLAN_ORDER`; sort at the sink.
    """
    tables = checkpointed(table_diff(src_catalog, tgt_catalog))
    one_sided = _leveled(tables.where("diff_type <> 'Common'"), src_edges, tgt_edges)
    added = one_sided.where("diff_type = 'Added'")
    removed = one_sided.where("diff_type = 'ExistingInTarget'")
    of_added = lambda df: df.join(added.select(*TABLE), list(TABLE), "left_semi")
    ddl = render_table_ddl(of_added(src_catalog), None if keys is None else of_added(keys), tgt_schema)
    rank = KIND_ORDER.index("Table")
    table_rows = lambda df, phase, level, diff_type, script: df.select(
        "database", F.lit(rank).alias("kind_rank"), F.lit(phase).alias("phase"), level.alias("level"),
        F.lit("Table").alias("kind"), F.col("table_name").alias("object_name"),
        F.lit(diff_type).alias("diff_type"), script.alias("diff_script"),
    )
    dropped = filled('DROP TABLE IF EXISTS {s}."{n}" CASCADE;', s=F.lit(tgt_schema), n=F.col("table_name"))
    section = F.when(F.col("change") == "ADD", 1).when(F.col("change") == "DROP", 2).otherwise(3)
    changes = column_diff(src_catalog, tgt_catalog, tables).select(
        *TABLE, F.struct(section.alias("s"), "column_name", "position", alter_statement(tgt_schema).alias("text")).alias("_line")
    )
    if object_options.get("include_owner") and src_objects is not None and tgt_objects is not None:
        changes = changes.unionByName(_owner_lines(src_objects, tgt_objects, tables, tgt_schema, object_options.get("src_schema")))
    altered = changes.groupBy(*TABLE).agg(F.sort_array(F.collect_list("_line")).alias("_l"))
    plan = (
        table_rows(added.join(ddl, list(TABLE)), 1, F.col("level"), "Added", F.col("ddl"))
        .unionByName(table_rows(removed, 2, -F.col("level"), "ExistingInTarget", dropped))
        .unionByName(table_rows(altered, 3, F.lit(0), "Altered", F.array_join("_l.text", "\n")))
    )
    if src_objects is not None and tgt_objects is not None:
        objects = suppress_dependents(
            object_diff(src_objects, tgt_objects, tgt_schema=tgt_schema, **object_options), removed
        )
        kind_rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KIND_ORDER)])
        plan = plan.unionByName(
            objects.select(
                "database", kind_rank.alias("kind_rank"), F.lit(0).alias("phase"), F.lit(0).alias("level"),
                "kind", "object_name", "diff_type", "diff_script",
            )
        )
    return plan


PLAN_ORDER = ("database", "kind_rank", "phase", "level", "object_name")


def verify_schema(plan: DataFrame) -> DataFrame:
    """One row: changes left, and whether there are none."""
    return plan.agg(F.count("*").alias("remaining")).withColumn("passed", F.col("remaining") == 0)


def line_diff(src: DataFrame, tgt: DataFrame, doc: str, text: str) -> DataFrame:
    """Lines added, removed and kept between two versions of many texts.

    Lines are compared trimmed and without trailing commas. Copies of a line
    in a text are counted, combined before the shuffle, so a text of one
    repeated line costs one group: (doc, line, change, n_lines, first_line).
    """
    def lines(df: DataFrame, side: str) -> DataFrame:
        exploded = df.select(doc, F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
        n = lambda s: F.lit(1 if s == side else 0).cast("bigint")
        first = lambda s: (F.col("_pos") + 1) if s == side else F.lit(None).cast("int")
        return exploded.select(
            doc, same_line(F.col("_line")).alias("line"),
            n("s").alias("_s"), n("t").alias("_t"), first("s").alias("_fs"), first("t").alias("_ft"),
        )

    counts = lines(src, "s").unionAll(lines(tgt, "t")).groupBy(doc, "line").agg(
        F.sum("_s").alias("_s"), F.sum("_t").alias("_t"), F.min("_fs").alias("_fs"), F.min("_ft").alias("_ft")
    )
    kept = F.least("_s", "_t")
    change = lambda name, n, first: F.when(
        n > 0, F.struct(F.lit(name).alias("change"), n.alias("n_lines"), F.col(first).alias("first_line"))
    )
    changes = F.array_compact(
        F.array(
            change("added", F.col("_s") - kept, "_fs"),
            change("removed", F.col("_t") - kept, "_ft"),
            change("same", kept, "_fs"),
        )
    )
    return counts.select(doc, "line", F.inline(changes))
