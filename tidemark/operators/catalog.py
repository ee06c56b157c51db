"""Table and column drift between two catalogs of any number of databases.

A catalog frame has the columns of `CATALOG_SCHEMA`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.types import catalog_type, normalize_type, type_string
from tidemark.functions.values import sql_name

CATALOG_SCHEMA = (
    "database string, schema string, table_name string, ordinal int, column_name string, data_type string, "
    "char_len int, num_precision int, num_scale int, is_nullable boolean, column_default string"
)
TABLE = ("database", "schema", "table_name")
FACTS = ("ordinal", "data_type", "char_len", "num_precision", "num_scale", "is_nullable", "column_default")


def catalog_of(tables: Mapping[str, DataFrame], database: str = "", schema: str = "public") -> DataFrame:
    """Catalog of the given tables, from their schemas."""
    rows = []
    for name, df in sorted(tables.items()):
        for i, f in enumerate(df.schema, 1):
            dtype, length, precision, scale = catalog_type(f.dataType)
            rows.append((database, schema, name, i, f.name, dtype, length, precision, scale, f.nullable, None))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def catalog_from_export(export: DataFrame) -> DataFrame:
    """Catalog from rows of information_schema.columns, all databases at once."""
    text = lambda c: F.col(c).cast("string")
    number = lambda c: F.col(c).cast("int")
    return export.select(
        text("table_catalog").alias("database"), text("table_schema").alias("schema"), text("table_name").alias("table_name"),
        number("ordinal_position").alias("ordinal"), text("column_name").alias("column_name"),
        text("data_type").alias("data_type"), number("character_maximum_length").alias("char_len"),
        number("numeric_precision").alias("num_precision"), number("numeric_scale").alias("num_scale"),
        (F.upper("is_nullable") == "YES").alias("is_nullable"), text("column_default").alias("column_default"),
    )


def column_type(prefix: str = "") -> Column:
    """Type text of a catalog row."""
    c = lambda name: F.col(prefix + name)
    return type_string(c("data_type"), c("char_len"), c("num_precision"), c("num_scale"))


def table_diff(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Every table as Added, ExistingInTarget or Common. One aggregation over
    both catalogs, combined before the shuffle."""
    sides = src.select(*TABLE, F.lit(1).alias("_s"), F.lit(0).alias("_t")).unionAll(
        tgt.select(*TABLE, F.lit(0).alias("_s"), F.lit(1).alias("_t"))
    )
    return sides.groupBy(*TABLE).agg(F.max("_s").alias("_s"), F.max("_t").alias("_t")).select(
        *TABLE,
        F.when(F.col("_t") == 0, "Added").when(F.col("_s") == 0, "ExistingInTarget").otherwise("Common").alias("diff_type"),
    )


def column_diff(src: DataFrame, tgt: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Changes of the columns of common tables: ADD, DROP, TYPE, SET/DROP NOT
    NULL, SET/DROP DEFAULT; one column may have several, numbered in that order.

    The rows carry the new type, nullability and default, so an added column
    can be written out in full. ``tables`` is their `table_diff` where the
    caller has it already, which saves a scan of both catalogs.
    """
    names = [*TABLE, "column_name"]
    side = lambda df, p: df.select(*[F.col(n).alias(p + n) for n in (*names, *FACTS)])
    on = None
    for n in names:
        on = (F.col("s_" + n) == F.col("t_" + n)) if on is None else on & (F.col("s_" + n) == F.col("t_" + n))
    s, t = (lambda n: F.col("s_" + n)), (lambda n: F.col("t_" + n))
    only_s, only_t = t("column_name").isNull(), s("column_name").isNull()
    both = ~only_s & ~only_t
    differs = lambda n: ~s(n).eqNullSafe(t(n))
    type_changed = (
        (normalize_type(s("data_type")) != normalize_type(t("data_type")))
        | differs("char_len") | differs("num_precision") | differs("num_scale")
    )
    default = lambda side: F.coalesce(side("column_default"), F.lit(""))
    default_changed = default(s) != default(t)

    def change(position: int, when: Column, name: Column, old: Column, new: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(position).alias("position"), name.alias("change"),
                old.cast("string").alias("old_value"), new.cast("string").alias("new_value"),
            ),
        )

    null = F.lit(None).cast("string")
    changes = F.array_compact(
        F.array(
            change(1, only_s, F.lit("ADD"), null, column_type("s_")),
            change(2, only_t, F.lit("DROP"), column_type("t_"), null),
            change(3, both & type_changed, F.lit("TYPE"), column_type("t_"), column_type("s_")),
            change(
                4, both & differs("is_nullable"),
                F.when(s("is_nullable"), "DROP NOT NULL").otherwise("SET NOT NULL"), t("is_nullable"), s("is_nullable"),
            ),
            change(
                5, both & default_changed,
                F.when(default(s) == "", "DROP DEFAULT").otherwise("SET DEFAULT"), t("column_default"), s("column_default"),
            ),
        )
    )
    changed = only_s | only_t | type_changed | differs("is_nullable") | default_changed
    found = side(src, "s_").join(side(tgt, "t_"), on, "full_outer").where(changed).select(
        *[F.coalesce("s_" + n, "t_" + n).alias(n) for n in names],
        s("is_nullable").alias("new_nullable"), s("column_default").alias("new_default"),
        F.inline(changes),
    )
    tables = table_diff(src, tgt) if tables is None else tables
    common = tables.where("diff_type = 'Common'").select(*TABLE)
    return found.join(common, list(TABLE), "left_semi")


def alter_statement(target_schema: str) -> Column:
    """ALTER TABLE text for a row of `column_diff`."""
    head = F.concat(F.lit(f"ALTER TABLE {target_schema}."), F.lit('"'), F.col("table_name"), F.lit('" '))
    name = F.concat(F.lit('"'), F.col("column_name"), F.lit('"'))
    alter = lambda *tail: F.concat(head, F.lit("ALTER COLUMN "), name, *tail, F.lit(";"))
    return (
        F.when(F.col("change") == "ADD", F.concat(head, F.lit("ADD COLUMN "), name, F.lit(" "), F.col("new_value"), F.lit(";")))
        .when(F.col("change") == "DROP", F.concat(head, F.lit("DROP COLUMN "), name, F.lit(";")))
        .when(F.col("change") == "TYPE", alter(F.lit(" TYPE "), F.col("new_value")))
        .when(F.col("change") == "SET DEFAULT", alter(F.lit(" SET DEFAULT "), F.col("new_value")))
        .otherwise(alter(F.lit(" "), F.col("change")))
    )


def render_table_ddl(catalog: DataFrame, keys: DataFrame | None = None, schema: str | None = None) -> DataFrame:
    """CREATE TABLE text per table, columns in ordinal order, key line last.

    ``keys`` has (database, schema, table_name, key_position, key_column). The
    lists gathered per table are as long as the table is wide (a PostgreSQL
    table has at most 1,600 columns). ``schema``
    replaces the schema name in the text.
    """
    line = F.concat(
        F.lit("    "), "column_name", F.lit(" "), column_type(),
        F.when(F.coalesce("column_default", F.lit("")) != "", F.concat(F.lit(" DEFAULT "), "column_default")).otherwise(F.lit("")),
        F.when(F.col("is_nullable"), F.lit(" NULL")).otherwise(F.lit(" NOT NULL")),
    )
    lines = F.sort_array(F.collect_list(F.struct("ordinal", "column_name", line.alias("line"))))
    tables = catalog.groupBy(*TABLE).agg(lines.alias("_lines")).withColumn("_lines", F.col("_lines.line"))
    if keys is not None:
        key_columns = F.sort_array(F.collect_list(F.struct("key_position", "key_column")))
        named = keys.groupBy(*TABLE).agg(key_columns.alias("_key")).withColumn("_key", F.col("_key.key_column"))
        # Fixed value: numbered table prefixes are not part of a key's name.
        name = F.regexp_replace(F.lower("table_name"), "^u[0-9]{2}_(?=.)", "")
        key_line = F.concat(F.lit("    CONSTRAINT pk_"), name, F.lit(" PRIMARY KEY ("), F.array_join("_key", ", "), F.lit(")"))
        with_key = F.concat(F.col("_lines"), F.array(key_line))
        tables = tables.join(named, list(TABLE), "left_outer").withColumn(
            "_lines", F.when(F.col("_key").isNotNull(), with_key).otherwise(F.col("_lines"))
        )
    place = F.lit(schema) if schema else F.col("schema")
    return tables.select(
        *TABLE,
        F.concat(
            F.lit("CREATE TABLE "), place, F.lit('."'), "table_name", F.lit('" (\n'),
            F.array_join("_lines", ",\n"), F.lit("\n);"),
        ).alias("ddl"),
    )


def drop_table_statement(target_schema: str, table: str) -> str:
    return f"DROP TABLE IF EXISTS {target_schema}.{sql_name(table)} CASCADE;"
