"""Text files: configuration trees and numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

CONFIG_FILES = "*.{json,env}"


def relative_to(folder: str, file: Column) -> Column:
    """File path below the folder; both may carry a scheme."""
    place = folder.split(":", 1)[-1].lstrip("/").rstrip("/")
    return F.substring_index(file, place + "/", -1) if place else file


def read_config_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the .json and .env files below a folder."""
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", CONFIG_FILES)
        .text(folder, wholetext=True)
    )
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(relative_to(folder, file).alias("path"), F.col("value").alias("content"))


def read_lines(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """(file, line_no, line) of text files, lines counted from 1.

    Files stay splittable: each block numbers its own lines, and the lines of
    the earlier blocks of the file are added. Should the two scans of a file be
    split differently, the job stops rather than number wrongly.
    """
    block = ["file", "start", "length"]
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
        F.monotonically_increasing_id().alias("position"),
        F.col("value").alias("line"),
    )
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        text.groupBy(*block).agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    )
    in_block = F.row_number().over(Window.partitionBy(*block).orderBy("position"))
    numbered = text.withColumn("in_block", in_block).join(starts, block, "left_outer")
    number = F.when(F.col("before").isNull(), F.raise_error(F.lit("file splits changed between two scans"))).otherwise(
        F.col("before") + F.col("in_block")
    )
    lines = numbered.select("file", number.cast("bigint").alias("line_no"), "line")
    return lines if max_lines is None else lines.where(F.col("line_no") <= max_lines)
