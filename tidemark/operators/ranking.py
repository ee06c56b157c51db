"""First rows of each class, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.columns import col

SALTS = 256


def first_per_class(df: DataFrame, classes: Sequence[str], order_by: Sequence[str], n: int) -> DataFrame:
    """The n first rows of every class. Classes are few and large, so each is
    cut down in salted parts before its first rows meet in one task, which
    then sees at most ``n * SALTS`` rows."""
    order = [col(o).asc_nulls_first() for o in order_by]
    salt = F.pmod(F.xxhash64(*[col(o) for o in order_by]), F.lit(SALTS))
    parts = Window.partitionBy(*[col(c) for c in classes], "_salt").orderBy(*order)
    whole = Window.partitionBy(*[col(c) for c in classes]).orderBy(*order)
    cut = (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(parts))
        .where(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )
    return cut.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= n).drop("_rank")
