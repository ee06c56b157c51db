"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A split hot key is worth another shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def get_session(app: str = "tidemark", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the one the cluster names, else a local
    folder, which only a local master may use."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """Name of a folder nobody has used, for tables of this application in the checkpoint folder."""
    folder = ensure_checkpoint_dir(spark)
    return f"{folder.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame as a table written once to the checkpoint folder.

    Loops keep short plans, later steps read only the columns they need and
    know the size of what they join, and a lost executor costs no more than
    the running step. The tables of an application are in one folder below
    the checkpoint folder, which can go when the application has ended.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.checkpoint_path = path
    return table


def at_once(jobs: Sequence[Callable[[], object]], threads: int = 8) -> list:
    """Results of functions that start Spark jobs, in their order. They run
    side by side, so that small jobs fill the gaps that large ones leave."""
    with ThreadPoolExecutor(threads) as pool:
        return [running.result() for running in [pool.submit(job) for job in jobs]]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder wherever Spark's files are; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Remove checkpointed tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.checkpoint_path)
