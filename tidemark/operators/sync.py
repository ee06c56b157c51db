"""From a row diff to ordered changes, statements and the resulting snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import JSON_OPTIONS, col, json_image, lower_set, null_safe
from tidemark.functions.values import key_predicate, sql_literal, sql_name
from tidemark.operators.diff import (
    CompareOptions,
    diff_summary_all,
    image_type,
    table_changes,
)
from tidemark.operators.edges import FkEdge, table_levels
from tidemark.operators.keys import largest_groups, union_all, with_occurrence

FEED_ORDER = ("phase", "level", "table_name", "op_rank", "key", "occurrence")


def statement(
    diff: DataFrame,
    table: str,
    keys: Sequence[str],
    schema: str = "public",
    ignore: Sequence[str] = (),
    upsert: bool = False,
) -> Column:
    """DELETE, INSERT, UPDATE or upsert text for a row of a row diff."""
    src, tgt = image_type(diff, "source"), image_type(diff, "target")
    names = [c for c in src.fieldNames() if c.lower() not in lower_set(ignore)]
    not_key = [c for c in names if c.lower() not in lower_set(keys)]
    where = f"{schema}.{sql_name(table)}"
    new = {c: sql_literal(F.col("source").getField(c), src[c].dataType) for c in names}
    old_key = key_predicate(keys, tgt, F.col("target").getField)
    values = F.concat_ws(", ", *new.values())
    insert = F.concat(
        F.lit(f"INSERT INTO {where} ({', '.join(map(sql_name, names))}) VALUES ("), values, F.lit(")")
    )
    if upsert:
        action = "DO UPDATE SET " + ", ".join(f"{sql_name(c)} = EXCLUDED.{sql_name(c)}" for c in not_key)
        conflict = f" ON CONFLICT ({', '.join(map(sql_name, keys))}) {action if not_key else 'DO NOTHING'};"
        write = update = F.concat(insert, F.lit(conflict))
    else:
        write = F.concat(insert, F.lit(";"))
        sets = [
            F.when(F.array_contains("changed_columns", c), F.concat(F.lit(f"{sql_name(c)} = "), new[c]))
            for c in not_key
        ]
        update = F.concat(F.lit(f"UPDATE {where} SET "), F.concat_ws(", ", *sets), F.lit(" WHERE "), old_key, F.lit(";"))
    return (
        F.when(F.col("op") == "D", F.concat(F.lit(f"DELETE FROM {where} WHERE "), old_key, F.lit(";")))
        .when(F.col("op") == "I", write)
        .when(F.col("op") == "U", update)
    )


def render_dml(
    diff: DataFrame,
    table: str,
    keys: Sequence[str],
    schema: str = "public",
    ignore: Sequence[str] = (),
    upsert: bool = False,
) -> DataFrame:
    """One statement per change of a row diff."""
    text = statement(diff, table, keys, schema, ignore, upsert)
    return diff.where("op <> 'S'").select(
        "op", *[col(k) for k in keys], "occurrence", text.alias("statement")
    )


def feed_of(
    diffs: Mapping[str, DataFrame],
    keys_by_table: Mapping[str, Sequence[str]],
    edges: Sequence[FkEdge],
    schema: str = "public",
    ignore: Sequence[str] = (),
    upsert: bool = False,
) -> DataFrame:
    """Changes of some row diffs in the order they can be applied: deletes
    from children to parents, then inserts and updates from parents to
    children. Keys and row images are JSON, since tables differ in type.

    The frame carries its order in `FEED_ORDER`; `ordered_feed` sorts it.
    """
    if not diffs:
        raise ValueError("no table with a key is on both sides")
    levels = table_levels(diffs, edges)
    is_delete = F.col("op") == "D"
    return union_all(
        [
            diff.where("op <> 'S'").select(
                F.when(is_delete, F.lit(1)).otherwise(F.lit(2)).alias("phase"),
                F.when(is_delete, F.lit(-levels[table])).otherwise(F.lit(levels[table])).alias("level"),
                F.lit(table).alias("table_name"),
                F.when(F.col("op") == "U", F.lit(2)).otherwise(F.lit(1)).alias("op_rank"),
                "op",
                json_image(keys_by_table[table]).alias("key"),
                "occurrence",
                F.to_json("target", JSON_OPTIONS).alias("before"),
                F.to_json("source", JSON_OPTIONS).alias("after"),
                "changed_columns",
                statement(diff, table, keys_by_table[table], schema, ignore, upsert).alias("statement"),
            )
            for table, diff in diffs.items()
        ]
    )


def change_feed(
    src_tables: Mapping[str, DataFrame],
    tgt_tables: Mapping[str, DataFrame],
    keys_by_table: Mapping[str, Sequence[str]],
    edges: Sequence[FkEdge],
    options: CompareOptions = CompareOptions(),
    schema: str = "public",
    upsert: bool = False,
) -> DataFrame:
    """`feed_of` all keyed tables of two snapshots."""
    diffs = table_changes(src_tables, tgt_tables, keys_by_table, options)
    return feed_of(diffs, keys_by_table, edges, schema, options.ignore, upsert)


def ordered_feed(feed: DataFrame) -> DataFrame:
    """The feed sorted for its sink, by range partitions."""
    return feed.orderBy(*FEED_ORDER)


def feed_changes(feed: DataFrame, table: str, src: DataFrame, tgt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One table's changes of a feed, typed again as in its row diff."""
    read = lambda name, df: F.from_json(name, df.schema, JSON_OPTIONS)
    typed = feed.where(F.col("table_name") == table).select(
        "op", "occurrence", read("after", src).alias("source"), read("before", tgt).alias("target"), "changed_columns"
    )
    key = lambda k: F.coalesce(F.col("source").getField(k), F.col("target").getField(k)).alias(k)
    return typed.select("op", *[key(k) for k in keys], "occurrence", "source", "target", "changed_columns")


def apply_changes(
    tgt: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    mode: str = "update",
    ignore: Sequence[str] = (),
    largest_group: int | None = None,
    where: str | None = None,
) -> DataFrame:
    """The target after the changes (a row diff, with or without its S rows).

    ``where`` is the predicate the diff was made with: rows outside it, those
    of which it is not known included, are neither numbered nor changed.

    ``update`` sets the changed columns of a row, ``upsert`` all columns of
    the source that are neither key nor ignored. Ignored columns and columns
    missing in the source keep their value, and are null in inserted rows.
    """
    if mode not in ("update", "upsert"):
        raise ValueError(f"mode must be 'update' or 'upsert', not {mode!r}")
    outside = None
    if where:
        inside = F.coalesce(F.expr(where), F.lit(False))
        outside, tgt = tgt.where(~inside), tgt.where(inside)
    src_type = image_type(changes, "source")
    skip = lower_set(ignore)
    compared = [c for c in src_type.fieldNames() if c in set(tgt.columns) and c.lower() not in lower_set([*keys, *ignore])]
    if largest_group is None:
        largest_group = largest_groups({"t": (tgt, keys)})["t"]
    rows = with_occurrence(tgt, keys, compared, "_occurrence", largest_group)
    touched = changes.where("op IN ('U', 'D')").select(
        F.col("op").alias("_op"),
        F.col("changed_columns").alias("_changed"),
        F.col("source").alias("_new"),
        F.col("occurrence").alias("_o"),
        *[F.col("target").getField(k).alias("_k_" + k) for k in keys],
    )
    on = [(k, "_k_" + k) for k in keys]
    if largest_group > 1:
        on.append(("_occurrence", "_o"))

    def kept(c: str) -> Column:
        if c not in compared:
            return col(c)
        new = F.col("_new").getField(c).cast(tgt.schema[c].dataType)
        written = F.col("_op") == "U"
        if mode == "update":
            written = written & F.array_contains("_changed", c)
        return F.when(written, new).otherwise(col(c)).alias(c)

    def added(c: str) -> Column:
        dtype = tgt.schema[c].dataType
        if c in src_type.fieldNames() and c.lower() not in skip:
            return F.col("source").getField(c).cast(dtype).alias(c)
        return F.lit(None).cast(dtype).alias(c)

    remaining = (
        rows.join(touched, null_safe(on), "left_outer")
        .where(F.col("_op").isNull() | (F.col("_op") == "U"))
        .select(*[kept(c) for c in tgt.columns])
    )
    inserted = changes.where("op = 'I'").select(*[added(c) for c in tgt.columns])
    applied = remaining.unionByName(inserted)
    return applied if outside is None else applied.unionByName(outside)


def insert_if_absent(tgt: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with the rows whose key it does not hold. A key given more
    than once is inserted once, with its smallest row."""
    rest = [c for c in tgt.columns if c not in keys]
    new = rows.join(
        tgt.select(*[col(k).alias("_k_" + k) for k in keys]), null_safe((k, "_k_" + k) for k in keys), "left_anti"
    )
    if rest:
        row = F.min(F.struct(*[col(c) for c in rest])).alias("_row")
        new = new.groupBy(*[col(k) for k in keys]).agg(row).select(*[col(k) for k in keys], "_row.*")
    else:
        new = new.distinct()
    return tgt.unionByName(new)


def dry_run(changes: DataFrame, tgt: DataFrame) -> DataFrame:
    """Counts before and after the changes; nothing is written."""
    n = lambda op: F.coalesce(F.sum((F.col("op") == op).cast("bigint")), F.lit(0)).cast("bigint")
    rows = changes.select("op").unionAll(tgt.select(F.lit("row").alias("op")))
    return rows.agg(
        n("row").alias("rows_before"), n("I").alias("inserted"), n("D").alias("deleted"), n("U").alias("updated")
    ).withColumn("rows_after", F.expr("rows_before + inserted - deleted"))


def verify_sync(
    src_tables: Mapping[str, DataFrame],
    tgt_tables: Mapping[str, DataFrame],
    keys_by_table: Mapping[str, Sequence[str]],
    options: CompareOptions = CompareOptions(),
) -> DataFrame:
    """Pass or fail per table: is there nothing left to insert, update or delete?

    Checksums of key ranges are compared first, so sides that are equal are
    scanned once and neither shuffled by key nor joined; a range that differs
    is looked into key by key."""
    left = F.expr("inserted + updated + deleted")
    return diff_summary_all(src_tables, tgt_tables, keys_by_table, options, by_ranges=True).select(
        "table_name", left.alias("remaining"), (left == 0).alias("passed")
    )

