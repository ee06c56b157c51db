"""Table snapshots in, change sets and exports out."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.session import at_once, remove

MANIFEST = "_manifest"


def read_snapshot(
    spark: SparkSession,
    path: str,
    tables: Sequence[str],
    where: str | None = None,
    fmt: str = "parquet",
    suffix: str = "",
    **options: str,
) -> dict[str, DataFrame]:
    """Named tables under a folder, with one row filter put on all of them at
    the scan. ``fmt="jdbc"`` reads each name as dbtable with the options."""
    snapshot = {}
    for table in tables:
        reader = spark.read.format(fmt).options(**options)
        df = reader.option("dbtable", table).load() if fmt == "jdbc" else reader.load(f"{path}/{table}{suffix}")
        snapshot[table] = df.where(where) if where else df
    return snapshot


def spread(scan: DataFrame) -> DataFrame:
    """A scan of few file splits dealt out to all cores, for costly work per
    row; one of many splits is left alone. Takes frames without shuffles."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def write_change_set(feed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Persist a change feed, one folder per table and operation."""
    feed.write.mode(mode).partitionBy("table_name", "op").parquet(path)


def write_script(feed: DataFrame, path: str, order: Sequence[str], mode: str = "errorifexists") -> None:
    """The statements of a feed as text files that follow each other in order."""
    feed.orderBy(*order).select(F.col("statement").alias("value")).write.mode(mode).text(path)


def export_snapshot(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> DataFrame:
    """Write every table as parquet, side by side, and last of all a manifest:
    table_name, n_rows as read back from the written files, and columns.

    An export without manifest is not complete. ``overwrite`` removes the old
    manifest before it touches a table, so that a manifest never stands beside
    tables of another export.
    """
    if not tables:
        raise ValueError("there is no table to export")
    spark = next(iter(tables.values())).sparkSession
    manifest = f"{path}/{MANIFEST}"
    if mode == "overwrite":
        remove(spark, manifest)

    def written(table: str, df: DataFrame):
        df.write.mode(mode).parquet(f"{path}/{table}")
        columns = df.schema.json()
        return table, spark.read.schema(df.schema).parquet(f"{path}/{table}").count(), columns

    rows = at_once([lambda t=t, df=df: written(t, df) for t, df in sorted(tables.items())])
    spark.createDataFrame(rows, "table_name string, n_rows bigint, columns string").coalesce(1).write.mode(mode).parquet(manifest)
    return spark.read.parquet(manifest).select("table_name", "n_rows")


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a complete export, with the columns they were written
    with. One without manifest, or with other rows than it names, is refused."""
    named = spark.read.parquet(f"{path}/{MANIFEST}").collect()
    read = lambda r: spark.read.schema(T.StructType.fromJson(json.loads(r.columns))).parquet(f"{path}/{r.table_name}")
    tables = {r.table_name: read(r) for r in named}
    counts = at_once([df.count for df in tables.values()])
    wrong = [f"{r.table_name} has {n} rows, not {r.n_rows}" for r, n in zip(named, counts) if n != r.n_rows]
    if wrong:
        raise ValueError("the export is not what its manifest says: " + "; ".join(wrong))
    return tables
