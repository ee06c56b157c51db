"""Keys of a table: profile, numbering of repeats, set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.columns import any_of, col, null_safe
from tidemark.session import checkpointed

# Rows of one key that a single task may sort; larger groups are split.
HOT_GROUP_ROWS = 1_000_000


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def key_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, rows with a null in the key, repeated
    keys, rows beyond the first of their key, size of the largest group."""
    groups = df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("_n"))
    has_null = any_of(col(k).isNull() for k in keys)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return groups.agg(
        total(F.col("_n")).alias("n_rows"),
        F.count("*").alias("n_keys"),
        total(F.when(has_null, F.col("_n"))).alias("null_key_rows"),
        total((F.col("_n") > 1).cast("int")).alias("duplicate_keys"),
        total(F.col("_n") - 1).alias("excess_rows"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("largest_group"),
    )


def largest_groups(frames: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> dict[str, int]:
    """Rows of the largest key group of every frame, found in one job that
    reads only the key columns and counts before it shuffles."""
    if not frames:
        return {}
    sizes = [
        df.groupBy(*[col(k) for k in keys]).count()
        .agg(F.coalesce(F.max("count"), F.lit(0)).alias("n"))
        .select(F.lit(name).alias("name"), "n")
        for name, (df, keys) in frames.items()
    ]
    return {r["name"]: r["n"] for r in union_all(sizes).collect()}


def _order(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Ascending, nulls first; maps have no order and go by their entries."""
    columns = []
    for n in names:
        dtype = df.schema[n].dataType
        if isinstance(dtype, T.MapType):
            columns.append(F.sort_array(F.map_entries(col(n))).asc_nulls_first())
        elif isinstance(dtype, T.VariantType):
            columns.append(F.to_json(col(n)).asc_nulls_first())
        else:
            columns.append(col(n).asc_nulls_first())
    return columns


def with_occurrence(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] = (),
    name: str = "occurrence",
    largest_group: int | None = None,
    hot_group_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Number the rows of each key from 1, ordered by ``order_by`` and then by
    all other columns, so that the numbers do not depend on arrival.

    ``largest_group`` is the known size of the largest key group; when it is
    not given one job counts it. Unique keys need no sort at all, and groups
    beyond ``hot_group_rows`` are numbered by many tasks (`_split_numbering`).
    """
    if largest_group is None:
        largest_group = largest_groups({"df": (df, keys)})["df"]
    if largest_group <= 1:
        return df.withColumn(name, F.lit(1).cast("bigint"))
    taken = {*keys, *order_by}
    order = [*order_by, *[c for c in df.columns if c not in taken]]
    if largest_group <= hot_group_rows:
        return _numbered(df, keys, order, name)
    hot = checkpointed(
        df.groupBy(*[col(k).alias("_hot_" + k) for k in keys])
        .agg(F.count("*").alias("_hot_rows"))
        .where(F.col("_hot_rows") > hot_group_rows)
    )
    parts = hot.agg(F.ceil(F.sum("_hot_rows") / F.lit(hot_group_rows))).first()[0]
    on = null_safe((k, "_hot_" + k) for k in keys)
    cold = _numbered(df.join(hot, on, "left_anti"), keys, order, name)
    return cold.unionByName(_split_numbering(df.join(hot, on, "left_semi"), keys, order, name, int(parts)))


def _numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    ordering = _order(df, order) or [F.lit(1)]
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*ordering)
    return df.withColumn(name, F.row_number().over(window).cast("bigint"))


def _split_numbering(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, parts: int) -> DataFrame:
    """Row numbers of large groups without one task per group.

    The rows themselves are range-partitioned by key and order, each range
    numbers its own rows, and the sizes of the earlier ranges are added. The
    written rows get a number that breaks ties, so equal rows spread too.
    """
    names = df.columns
    # Written first: the tie-breaker must not change when a task runs again.
    rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    ordering = [*[col(k).asc_nulls_first() for k in keys], *_order(df, order), F.col("_row")]
    ranges = checkpointed(rows.repartitionByRange(parts, *ordering).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*[col(k) for k in keys], "_range").orderBy(*_order(df, order), "_row")
    placed = ranges.withColumn("_in_range", F.row_number().over(inside))
    earlier = Window.partitionBy(*[col("_k_" + k) for k in keys]).orderBy("_k_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.groupBy(*[col(k).alias("_k_" + k) for k in keys], F.col("_range").alias("_k_range")).agg(F.count("*").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    )
    on = null_safe([*[(k, "_k_" + k) for k in keys], ("_range", "_k_range")])
    number = (F.col("_start") + F.col("_in_range")).cast("bigint").alias(name)
    return placed.join(starts, on).select(*[col(c) for c in names], number)


def key_presence(src: DataFrame, tgt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every distinct key with its rows in source and target. One aggregation
    over both sides: nulls group together and repeated keys are counted
    before the shuffle."""
    names = [col(k) for k in keys]
    sides = src.select(*names, F.lit(1).alias("_s"), F.lit(0).alias("_t")).unionAll(
        tgt.select(*names, F.lit(0).alias("_s"), F.lit(1).alias("_t"))
    )
    return sides.groupBy(*names).agg(F.sum("_s").alias("source_rows"), F.sum("_t").alias("target_rows"))


def inserted_keys(src: DataFrame, tgt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys found only in the source."""
    return key_presence(src, tgt, keys).where("target_rows = 0").select(*[col(k) for k in keys])


def deleted_keys(src: DataFrame, tgt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys found only in the target."""
    return key_presence(src, tgt, keys).where("source_rows = 0").select(*[col(k) for k in keys])


def common_keys(src: DataFrame, tgt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys found on both sides."""
    return key_presence(src, tgt, keys).where("source_rows > 0 AND target_rows > 0").select(*[col(k) for k in keys])
