"""Documents packed into bins of a fixed length, conflicting ones apart.

Best-fit decreasing with conflicts: bins are kept in the order of what room
they have left, and each carries two bitmaps, of the sources and of the
duplicate clusters in it. A piece goes to the first bin in that order, from
the tightest that has room for it, whose bitmaps have neither its source nor
its cluster; if there is none, it opens a bin.

Documents are dealt by a hash into groups of about `GROUP_ROWS`, which are
packed independently: with thousands of pieces the fill of the bins no longer
depends on the number, and a source or cluster with a third of all rows is
dealt evenly. Only lengths, sources and clusters move, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 4000
CAPACITY = 2048


def pack(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every piece, packed in the given order; None conflicts with nothing."""
    source_bit, cluster_bit = {}, {}
    order: list[tuple[int, int]] = []  # (room left, bin)
    held: list[list[int]] = []  # bitmaps of sources and of clusters
    out = []
    for length, source, cluster in zip(lengths, sources, clusters):
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(order, (length, -1))
        while at < len(order) and (held[order[at][1]][0] & s or held[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            room, number = order.pop(at)
        else:
            room, number = capacity, len(held)
            held.append([0, 0])
        out.append((number, capacity - room))
        held[number][0] |= s
        held[number][1] |= c
        if room > length:
            insort(order, (room - length, number))
    return out


def _group(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "tie", "piece"], ascending=[False, True, True], kind="stable")
        value = lambda c: [None if pd.isna(x) else x for x in rows[c]]
        placed = pack(rows["length"].tolist(), value("source"), value("cluster"), capacity)
        rows["bin"] = [b for b, _ in placed]
        rows["bin_offset"] = [o for _, o in placed]
        rows["bin_length"] = rows.groupby("bin")["length"].transform("sum")
        rows["bin_id"] = rows["group"] * (1 << 32) + rows["bin"]
        return rows[["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_length"]]

    return run


def best_fit(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source",
    cluster_col: str | None = None, length_col: str | None = None, clusters: DataFrame | None = None,
) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset, bin_length, one row per piece.

    The length of a document is `length_col`, or else its words and an end
    mark. A document longer than a bin is cut into full pieces and a rest, so
    nothing is dropped; pieces of one document are in different bins. Its
    cluster is `cluster_col`, or that which `clusters` (doc_id, text_hash,
    cluster; text_hash is xxhash64 of the text) has for its id and text, or
    else a hash of the whole text. If `clusters` has a column n_words, it must
    have every text; words are then not counted again.

    Null and empty texts are an end mark and in no cluster; a null source or
    cluster conflicts with nothing; a null or negative length is 0. Repeated
    rows are documents of one cluster. Null ids are packed like others. Other
    columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Word counts that come with the clusters spare a second pass over the texts.
    counted = clusters is not None and "n_words" in clusters.columns and not length_col
    if length_col:
        length = F.col(length_col).cast("long")
    else:
        length = F.lit(0) if counted else F.regexp_count(text, F.lit(r"\S+")).cast("long") + 1
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.when(text != "", F.xxhash64(text).cast("string"))
    source = F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).alias("whole"),
        source.alias("source"), cluster.alias("cluster"), F.xxhash64(F.col(id_col), text).alias("tie"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
    )
    if clusters is not None:
        # Null ids are ids like any other.
        of = clusters.select(
            F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("cluster").cast("string").alias("given"),
            *(["n_words"] if counted else []),
        ).distinct()
        rows = rows.join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").withColumn(
            "cluster", F.coalesce(F.concat(F.lit("given "), F.col("given")), "cluster")
        )
        if counted:
            missing = F.raise_error(F.lit("a text without n_words in clusters")).cast("long")
            rows = rows.withColumn("whole", F.coalesce(F.col("n_words").cast("long"), missing) + 1)
    groups = max(1, -(-docs.count() // GROUP_ROWS))
    last = F.greatest(F.lit(0), F.floor((F.col("whole") - 1) / capacity).cast("int"))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id", "source", "cluster", "tie", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece").cast("long") * capacity).alias("length"),
        # By id and text, so that pieces of one long document and copies spread.
        F.pmod(F.xxhash64("tie", "piece", "doc_id"), F.lit(groups)).alias("group"),
    )
    return pieces.groupBy("group").applyInPandas(
        _group(capacity), "doc_id long, piece int, start long, length long, bin_id long, bin_offset long, bin_length long"
    )
