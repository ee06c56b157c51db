"""Keyed row comparison of two snapshots of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.columns import any_of, col, lower_set, null_safe, renamed
from tidemark.functions.values import changed_columns, value_changed
from tidemark.operators.digests import (
    comparable_keys, differing_keys, differing_numbers, differing_ranges, key_number, key_range, may_number,
)
from tidemark.operators.keys import largest_groups, union_all, with_occurrence
from tidemark.operators.ranking import first_per_class
from tidemark.session import at_once, checkpointed

SUMMARY_COLUMNS = ("inserted", "deleted", "updated", "source_rows", "target_rows")


@dataclass(frozen=True)
class CompareOptions:
    """ignore: columns left out of the comparison, any letter case;
    where: SQL predicate put on both sides; ts_tolerance_ms: timestamps this
    close are equal; unique_keys: True when the source enforces the key, which
    saves the job that counts repeats."""

    ignore: Sequence[str] = field(default=())
    where: str | None = None
    ts_tolerance_ms: float = 1
    unique_keys: bool = False


def parse_column_list(text: str) -> list[str]:
    """Comma-separated column names as a user types them."""
    return [c.strip() for c in text.split(",") if c.strip()]


def compared_columns(src: DataFrame, tgt: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> list[str]:
    """Columns of both sides that are neither key nor ignored, in source order."""
    skip = lower_set([*keys, *ignore])
    return [c for c in src.columns if c in set(tgt.columns) and c.lower() not in skip]


def _filtered(df: DataFrame, where: str | None) -> DataFrame:
    return df.where(where) if where else df


def row_diff(
    src: DataFrame,
    tgt: DataFrame,
    keys: Sequence[str],
    options: CompareOptions = CompareOptions(),
    largest_group: int | None = None,
) -> DataFrame:
    """Every row of both sides once, classed as

    I (source only), D (target only), U (a compared column differs) or S.

    Columns: op, the keys, occurrence, source and target row images,
    changed_columns. Repeats of a key are paired by their occurrence number.
    Callers that need only some of these columns read only what those need.
    """
    if not keys:
        raise ValueError("row_diff needs at least one key column")
    src, tgt = _filtered(src, options.where), _filtered(tgt, options.where)
    compared = compared_columns(src, tgt, keys, options.ignore)
    if options.unique_keys:
        largest_group = 1
    elif largest_group is None:
        largest_group = max(largest_groups({"s": (src, keys), "t": (tgt, keys)}).values())

    def side(df: DataFrame, prefix: str) -> DataFrame:
        numbered = with_occurrence(df, keys, compared, "_occurrence", largest_group)
        return numbered.select(
            F.lit(True).alias(prefix + "_here"),
            F.col("_occurrence").alias(prefix + "_occurrence"),
            *[col(c).alias(f"{prefix}.{c}") for c in df.columns],
        )

    on = [(f"s.{k}", f"t.{k}") for k in keys]
    if largest_group > 1:
        on.append(("s_occurrence", "t_occurrence"))
    joined = side(src, "s").join(side(tgt, "t"), null_safe(on), "full_outer")
    flags = [
        (c, value_changed(col(f"s.{c}"), col(f"t.{c}"), src.schema[c].dataType, tgt.schema[c].dataType, options.ts_tolerance_ms))
        for c in compared
    ]
    op = (
        F.when(F.col("t_here").isNull(), F.lit("I"))
        .when(F.col("s_here").isNull(), F.lit("D"))
        .when(any_of(flag for _, flag in flags), F.lit("U"))
        .otherwise(F.lit("S"))
    )
    is_update = F.col("s_here").isNotNull() & F.col("t_here").isNotNull()

    def image(df: DataFrame, prefix: str) -> Column:
        row = F.struct(*[col(f"{prefix}.{c}").alias(c) for c in df.columns])
        return F.when(F.col(prefix + "_here").isNotNull(), row)

    return joined.select(
        op.alias("op"),
        *[F.when(F.col("s_here").isNotNull(), col(f"s.{k}")).otherwise(col(f"t.{k}")).alias(k) for k in keys],
        F.coalesce("s_occurrence", "t_occurrence").alias("occurrence"),
        image(src, "s").alias("source"),
        image(tgt, "t").alias("target"),
        F.when(is_update, changed_columns(flags)).otherwise(F.array().cast("array<string>")).alias("changed_columns"),
    )


def row_changes(
    src: DataFrame,
    tgt: DataFrame,
    keys: Sequence[str],
    options: CompareOptions = CompareOptions(),
    by_ranges: bool = False,
) -> DataFrame:
    """The rows of `row_diff` that are not S, found by digests first.

    One shuffle of key numbers and digests, combined before it, finds the keys
    whose rows differ; they are written, and only rows of those keys are numbered,
    joined and compared cell by cell. Rows of unchanged keys never move. The
    written keys are as many as there are changed keys, and Spark broadcasts
    them only where that is small.

    ``by_ranges`` compares checksums of key ranges before that, so that equal
    sides cost one scan each and no shuffle of keys: for sides that are
    expected to be equal. Keys whose types differ between the sides cannot be
    hashed together and take the way of `row_diff`.
    """
    if not keys:
        raise ValueError("row_changes needs at least one key column")
    src, tgt = _filtered(src, options.where), _filtered(tgt, options.where)
    rest = replace(options, where=None)
    if not comparable_keys(src, tgt, keys):
        return row_diff(src, tgt, keys, rest).where("op <> 'S'")
    compared = compared_columns(src, tgt, keys, options.ignore)
    seen = [src, tgt]
    if by_ranges:
        ranges = checkpointed(differing_ranges(src, tgt, keys, compared).select(F.col("range").alias("_range")))
        seen = [df.join(ranges, key_range(keys) == F.col("_range"), "left_semi") for df in seen]
    numbered = may_number(src, keys)
    found = checkpointed((differing_numbers if numbered else differing_keys)(*seen, keys, compared))
    largest_group = 1
    if not options.unique_keys:
        largest_group = found.agg(F.max(F.greatest("source_rows", "target_rows"))).first()[0] or 0
    if numbered:
        wanted, on = found.select(F.col("number").alias("_number")), key_number(keys) == F.col("_number")
    else:
        wanted, on = renamed(found, keys, "_k_"), null_safe((k, "_k_" + k) for k in keys)
    fetched = lambda df: df.join(wanted, on, "left_semi")
    return row_diff(fetched(src), fetched(tgt), keys, rest, largest_group).where("op <> 'S'")


def summarize(diff: DataFrame) -> DataFrame:
    """One row of counts over a row diff."""
    rows = lambda *ops: F.coalesce(F.sum(F.col("op").isin(*ops).cast("bigint")), F.lit(0)).cast("bigint")
    return diff.agg(
        rows("I").alias("inserted"),
        rows("D").alias("deleted"),
        rows("U").alias("updated"),
        rows("I", "U", "S").alias("source_rows"),
        rows("D", "U", "S").alias("target_rows"),
    ).withColumn("has_differences", F.expr("inserted + deleted + updated > 0"))


def diff_summary(
    table: str,
    src: DataFrame,
    tgt: DataFrame,
    keys: Sequence[str],
    options: CompareOptions = CompareOptions(),
    by_ranges: bool = False,
) -> DataFrame:
    """Counts and status of one table; a table without key is all zero.
    Only changed rows are compared, see `row_changes`; rows are counted by
    scans that read no column unless there is a filter."""
    if keys:
        rows = lambda df, what: _filtered(df, options.where).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        changes = row_changes(src, tgt, keys, options, by_ranges).groupBy(F.col("op").alias("what")).agg(F.count("*").alias("n"))
        n = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).cast("bigint")
        counts = union_all([changes, rows(src, "source"), rows(tgt, "target")]).agg(
            n("I").alias("inserted"), n("D").alias("deleted"), n("U").alias("updated"),
            n("source").alias("source_rows"), n("target").alias("target_rows"),
        ).withColumn("has_differences", F.expr("inserted + deleted + updated > 0"))
        status = F.when(F.col("has_differences"), F.lit("Different")).otherwise(F.lit("Synchronized"))
    else:
        counts = src.sparkSession.range(1).select(
            *[F.lit(0).cast("bigint").alias(c) for c in SUMMARY_COLUMNS], F.lit(False).alias("has_differences")
        )
        status = F.lit("no_key")
    return counts.select(F.lit(table).alias("table_name"), "*", status.alias("status"))


def group_sizes(
    src_tables: Mapping[str, DataFrame],
    tgt_tables: Mapping[str, DataFrame],
    keys_by_table: Mapping[str, Sequence[str]],
    options: CompareOptions,
) -> dict[str, int]:
    """Largest key group of every table over both sides, found in one job."""
    keyed = [t for t in src_tables if t in tgt_tables and keys_by_table.get(t)]
    if options.unique_keys:
        return dict.fromkeys(keyed, 1)
    sides = {
        f"{side}{t}": (_filtered(tables[t], options.where), keys_by_table[t])
        for side, tables in (("s", src_tables), ("t", tgt_tables))
        for t in keyed
    }
    sizes = largest_groups(sides)
    return {t: max(sizes["s" + t], sizes["t" + t]) for t in keyed}


def row_diffs(
    src_tables: Mapping[str, DataFrame],
    tgt_tables: Mapping[str, DataFrame],
    keys_by_table: Mapping[str, Sequence[str]],
    options: CompareOptions = CompareOptions(),
) -> dict[str, DataFrame]:
    """Row diff of every table that is on both sides and has a key."""
    sizes = group_sizes(src_tables, tgt_tables, keys_by_table, options)
    return {
        t: row_diff(src_tables[t], tgt_tables[t], keys_by_table[t], options, sizes[t]) for t in sorted(sizes)
    }


def table_changes(
    src_tables: Mapping[str, DataFrame],
    tgt_tables: Mapping[str, DataFrame],
    keys_by_table: Mapping[str, Sequence[str]],
    options: CompareOptions = CompareOptions(),
) -> dict[str, DataFrame]:
    """`row_changes` of every table that is on both sides and has a key; the
    jobs that find changed keys run side by side."""
    keyed = [t for t in sorted(src_tables) if t in tgt_tables and keys_by_table.get(t)]
    one = lambda t: lambda: row_changes(src_tables[t], tgt_tables[t], keys_by_table[t], options)
    return dict(zip(keyed, at_once([one(t) for t in keyed])))


def diff_summary_all(
    src_tables: Mapping[str, DataFrame],
    tgt_tables: Mapping[str, DataFrame],
    keys_by_table: Mapping[str, Sequence[str]],
    options: CompareOptions = CompareOptions(),
    by_ranges: bool = False,
) -> DataFrame:
    """`diff_summary` of every table found on both sides, as one plan; the
    jobs that find changed keys run side by side."""
    names = [t for t in sorted(src_tables) if t in tgt_tables]
    one = lambda t: lambda: diff_summary(t, src_tables[t], tgt_tables[t], keys_by_table.get(t, ()), options, by_ranges)
    return union_all(at_once([one(t) for t in names]))


def diff_detail(diff: DataFrame, keys: Sequence[str], limit_per_class: int | None = None) -> DataFrame:
    """The row diff, or the first rows of each class in key order. The limit
    is applied after classing, so no change is lost behind unchanged rows."""
    if limit_per_class is None:
        return diff
    return first_per_class(diff, ["op"], [*keys, "occurrence"], limit_per_class)


def diff_side_by_side(diff: DataFrame) -> DataFrame:
    """Two lines for each updated row, New before Old, cells as text."""
    images = {side: diff.schema[side].dataType.fieldNames() for side in ("source", "target")}
    names = sorted({*images["source"], *images["target"]})

    def line(position: int, label: str, side: str, changed: Column) -> Column:
        cells = [
            (F.coalesce(F.col(side).getField(c).cast("string"), F.lit("NULL")) if c in images[side] else F.lit("NULL")).alias(c)
            for c in names
        ]
        return F.struct(F.lit(position).alias("line"), F.lit(label).alias("row_type"), changed.alias("changed_columns"), *cells)

    lines = F.array(
        line(1, "New", "source", F.array_join("changed_columns", ", ")),
        line(2, "Old", "target", F.lit("")),
    )
    rows = diff.where("op = 'U'").select("occurrence", F.explode(lines).alias("l"))
    return rows.select("occurrence", "l.*")


def diff_class_counts(diff: DataFrame) -> DataFrame:
    """Rows per class, under the labels a reviewer sees."""
    label = (
        F.when(F.col("op") == "I", "Added").when(F.col("op") == "D", "Removed")
        .when(F.col("op") == "U", "Changed").otherwise("Identical")
    )
    return diff.groupBy(label.alias("diff_class")).agg(F.count("*").alias("n_rows"))


def image_type(diff: DataFrame, side: str) -> T.StructType:
    """Row type of the source or target image of a row diff."""
    return diff.schema[side].dataType
