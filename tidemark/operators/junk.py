"""Keyword scan over catalog objects, and the clean-up it suggests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import first_keyword

# System prefix, and the statement that removes an object of a
# kind; {s} schema, {n} name, {p} parent.
SYSTEM_PREFIX = "pg_"
# Objects of a schema are as many as there are; their schemas are few.
SHARES = 64
DROP_SCHEMA = 'DROP SCHEMA IF EXISTS "{s}" CASCADE;'
DROP_TEMPLATES = {
    "Table": 'DROP TABLE IF EXISTS "{s}"."{n}" CASCADE;',
    "View": 'DROP VIEW IF EXISTS "{s}"."{n}" CASCADE;',
    "Routine": 'DROP ROUTINE IF EXISTS "{s}"."{n}" CASCADE;',
    "Index": 'DROP INDEX IF EXISTS "{s}"."{n}" CASCADE;',
    "Column": 'ALTER TABLE "{s}"."{p}" DROP COLUMN IF EXISTS "{n}" CASCADE;',
    "Trigger": 'DROP TRIGGER IF EXISTS "{n}" ON "{s}"."{p}" CASCADE;',
    "Constraint": 'ALTER TABLE "{s}"."{p}" DROP CONSTRAINT IF EXISTS "{n}" CASCADE;',
    "DataType": 'DROP TYPE IF EXISTS "{s}"."{n}" CASCADE;',
    "Role": 'DROP ROLE IF EXISTS "{n}";',
    "Partition": 'DROP TABLE IF EXISTS "{s}"."{n}" CASCADE;',
    "MaterializedView": 'DROP MATERIALIZED VIEW IF EXISTS "{s}"."{n}" CASCADE;',
    "Sequence": 'DROP SEQUENCE IF EXISTS "{s}"."{n}" CASCADE;',
    "Aggregate": 'DROP AGGREGATE IF EXISTS "{s}"."{n}" CASCADE;',
    "Domain": 'DROP DOMAIN IF EXISTS "{s}"."{n}" CASCADE;',
}


def filled(template: str, **values: Column) -> Column:
    """The template with columns in place of its {names}."""
    parts, rest = [], template
    while rest:
        text, brace, rest = rest.partition("{")
        if text:
            parts.append(F.lit(text))
        if brace:
            name, _, rest = rest.partition("}")
            parts.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*parts)


def _share() -> Column:
    """One of `SHARES` parts that an object belongs to by its name."""
    return F.pmod(F.xxhash64("kind", "name", "parent"), F.lit(SHARES))


def _in_shares(schemas: DataFrame) -> DataFrame:
    """Schemas once per part, so that objects of one schema meet it in many tasks."""
    return schemas.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))))


def _in_scope(df: DataFrame, scopes: DataFrame | None, flag: str) -> DataFrame:
    """Rows of selected schemas; objects outside any schema, such as roles, stay."""
    if scopes is None:
        return df
    chosen = _in_shares(scopes.where(F.col(flag)).select(F.lower("schema").alias("_scope")).distinct())
    schema = F.lower(F.coalesce("schema", F.lit("")))
    return df.join(chosen, (schema == F.col("_scope")) & (_share() == F.col("_share")), "left_outer").where(
        F.col("_scope").isNotNull() | (schema == "")
    ).drop("_scope", "_share")


def scan_catalog(
    objects: DataFrame,
    columns: DataFrame,
    keywords: Sequence[str],
    scopes: DataFrame | None = None,
) -> DataFrame:
    """Objects whose name, definition, comment or column names hold a keyword
    as a token, with the first reason in that order.

    A schema that matches by name or comment is reported once and its members
    are not looked at. Names with the system prefix are left out. ``scopes``
    (schema, include_structure) limits the schemas; include_data is for the
    records, see `data_scope` in scan.py.
    """
    objects = _in_scope(objects, scopes, "include_structure")
    said = lambda what, c: F.concat(F.lit(what + " contains junk: "), first_keyword(F.col(c), keywords))
    own_reason = F.coalesce(said("Name", "name"), said("Source", "definition"), said("Comment", "comment"))
    is_schema = F.col("kind") == "Schema"
    schema_reason = F.coalesce(said("Name", "name"), said("Comment", "comment"))
    judged = objects.where(F.col("name") != "").withColumn(
        "_own", F.when(is_schema, schema_reason).otherwise(own_reason)
    )
    junk_schemas = (
        judged.where(is_schema & F.col("_own").isNotNull())
        .select(F.col("database").alias("_db"), F.col("name").alias("_schema")).distinct()
    )
    member = ~is_schema & (F.col("database") == F.col("_db")) & (F.col("schema") == F.col("_schema")) & (_share() == F.col("_share"))
    judged = judged.join(_in_shares(junk_schemas), member, "left_anti")
    keyword = first_keyword(F.col("column_name"), keywords)
    by_column = (
        columns.select("database", "schema", F.col("table_name").alias("name"), "ordinal", "column_name", keyword.alias("_kw"))
        .where("_kw IS NOT NULL")
        .groupBy("database", "schema", "name")
        .agg(F.min(F.struct("ordinal", "column_name", "_kw")).alias("_c"))
        .select(
            F.col("database").alias("_db"), F.col("schema").alias("_schema"), F.col("name").alias("_name"),
            F.concat(F.lit("Column '"), F.col("_c.column_name"), F.lit("' contains junk: "), F.col("_c._kw")).alias("_column"),
        )
    )
    of_table = (
        (F.col("kind") == "Table") & (F.col("database") == F.col("_db"))
        & (F.col("schema") == F.col("_schema")) & (F.col("name") == F.col("_name"))
    )
    found = judged.join(by_column, of_table, "left_outer").withColumn("reason", F.coalesce("_own", "_column"))
    system = F.lower(F.substring("name", 1, len(SYSTEM_PREFIX))) == SYSTEM_PREFIX
    return found.where(F.col("reason").isNotNull() & ~system).select(
        "database", "schema", "kind", "name", "parent", "reason"
    )


def cleanup_plan(items: DataFrame) -> DataFrame:
    """A drop statement per junk object, schemas first (phase 1); objects
    inside a dropped schema go with it."""
    schema_name = F.coalesce(F.col("schema"), F.lit(""))
    schemas = items.where("kind = 'Schema'").select("database", F.col("name").alias("schema")).distinct()
    drops = schemas.select(
        "database", F.lit(1).alias("phase"), "schema", F.lit("Schema").alias("kind"), F.col("schema").alias("name"),
        filled(DROP_SCHEMA, s=F.col("schema")).alias("statement"),
    )
    members = items.where("kind <> 'Schema'").withColumn("_share", _share())
    inside = members.join(_in_shares(schemas), ["database", "schema", "_share"], "left_anti")
    text = F.coalesce(
        *[
            F.when(F.col("kind") == kind, filled(t, s=schema_name, n=F.col("name"), p=F.col("parent")))
            for kind, t in DROP_TEMPLATES.items()
        ]
    )
    return drops.unionByName(
        inside.select("database", F.lit(2).alias("phase"), "schema", "kind", "name", text.alias("statement"))
        .where("statement IS NOT NULL")
    )
