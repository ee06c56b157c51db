"""Tables of both sides at a glance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.columns import col
from tidemark.operators.keys import union_all

STATUSES = ("Added", "Removed", "No key", "Comparable", "Different", "Synchronized")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, counted in one plan."""
    return union_all(
        [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in sorted(tables.items())]
    )


def key_high_water_marks(key_columns: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Largest key per table, at least the value a fresh sequence starts at."""
    return union_all(
        [
            df.agg(F.coalesce(F.max(col(k)), F.lit(1)).cast("bigint").alias("high_water_mark"))
            .select(F.lit(t).alias("table_name"), F.lit(k).alias("key_column"), "high_water_mark")
            for t, (df, k) in sorted(key_columns.items())
        ]
    )


def table_inventory(
    src_tables: Mapping[str, DataFrame],
    tgt_tables: Mapping[str, DataFrame],
    keys_by_table: Mapping[str, Sequence[str]],
    summaries: DataFrame | None = None,
) -> DataFrame:
    """All table names with a status and, for one-sided tables, their rows.
    With `diff_summary_all` as summaries, comparable tables take its status
    and counts."""
    def counted(df: DataFrame, table: str, status: str, side: str) -> DataFrame:
        n = F.col("n_rows")
        none = F.lit(None).cast("bigint")
        return df.agg(F.count("*").alias("n_rows")).select(
            F.lit(table).alias("table_name"), F.lit(status).alias("status"),
            (n if side == "source" else none).alias("source_rows"),
            (n if side == "target" else none).alias("target_rows"),
        )

    spark = next(iter([*src_tables.values(), *tgt_tables.values()])).sparkSession
    rows, two_sided = [], []
    for table in sorted({*src_tables, *tgt_tables}):
        if table not in tgt_tables:
            rows.append(counted(src_tables[table], table, "Added", "source"))
        elif table not in src_tables:
            rows.append(counted(tgt_tables[table], table, "Removed", "target"))
        else:
            two_sided.append((table, "Comparable" if keys_by_table.get(table) else "No key", None, None))
    if two_sided:
        schema = "table_name string, status string, source_rows bigint, target_rows bigint"
        rows.append(spark.createDataFrame(two_sided, schema))
    inventory = union_all(rows)
    if summaries is None:
        return inventory
    found = summaries.select(
        "table_name", F.col("status").alias("_status"), F.col("source_rows").alias("_s"), F.col("target_rows").alias("_t")
    )
    comparable = F.col("status") == "Comparable"
    return inventory.join(found, "table_name", "left_outer").select(
        "table_name",
        F.when(comparable, F.coalesce("_status", "status")).otherwise(F.col("status")).alias("status"),
        F.when(comparable, F.col("_s")).otherwise(F.col("source_rows")).alias("source_rows"),
        F.when(comparable, F.col("_t")).otherwise(F.col("target_rows")).alias("target_rows"),
    )


def filter_inventory(inventory: DataFrame, status: str) -> DataFrame:
    """Tables of one status; "All" keeps every table."""
    if status == "All":
        return inventory
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return inventory.where(F.col("status") == status)


def find_row(df: DataFrame, key_col: str, value: str) -> DataFrame:
    """The rows whose key, written as text, equals the value: one, unless the
    key repeats. The typed comparison follows from the text one and reaches
    the scan."""
    key = col(key_col)
    typed = F.lit(value).try_cast(df.schema[key_col].dataType)
    return df.where((key == typed) & (key.cast("string") == value))
