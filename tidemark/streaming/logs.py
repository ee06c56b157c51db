"""Log lines as a stream: the same stateless operators, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.lines import normalize_log, severity


def log_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Normalized lines of the log files that arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).withColumnRenamed("value", "line")
    return normalize_log(lines)


def severity_stream(lines: DataFrame) -> DataFrame:
    """Running lines per severity; three rows of state whatever the volume."""
    return lines.groupBy(severity(F.col("line")).alias("severity")).agg(F.count("*").alias("n_lines"))


def write_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append what has arrived to parquet, exactly once, and stop."""
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def count_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Bring the running counts up to date with what has arrived. Each batch
    writes the whole small result under its number; the newest one counts."""
    def save(batch: DataFrame, epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = (
        df.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of the newest batch written by `count_available`."""
    counts = spark.read.parquet(path)
    newest = counts.agg(F.max("epoch").alias("epoch"))
    return counts.join(newest, "epoch", "left_semi").select("severity", "n_lines")
