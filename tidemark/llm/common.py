"""What the operators share: settings, tables of a folder, graph components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpointed

#: Rows that Spark hands to a Python worker at once. Texts may be long, so few.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Keep what a Python worker holds at once small, whatever the row size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def learnable(doc_id: str = "doc_id"):
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def words_of(text: Column) -> Column:
    """Runs of letters and digits of a text, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def held(rows: DataFrame, *names: str) -> DataFrame:
    """The rows, with the named columns computed once.

    A filter over a computed column is otherwise pushed below it together with
    a copy of the whole computation, inside lambdas once for each element.
    """
    rest = [c for c in rows.columns if c not in names]
    return rows.select(*rest, F.inline(F.array(F.struct(*names))))


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node in a graph.

    `links` has the columns a and b (any orderable type, no nulls). Returns
    (node, root), one row per node that a link names, roots included.
    Every step points each node at the smallest node next to it, first from
    the large nodes' side, then from the small nodes' side, until no link
    changes; the number of steps grows with the logarithm of the longest path.
    A node's neighbours are only ever aggregated, never held together.
    """
    state = checkpointed(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    seen = None
    while True:
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # A node without smaller neighbours is its own smallest and sends nothing.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        )
        state = checkpointed(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        sign = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
