"""Short fingerprints of documents by one-permutation MinHash.

Only DataFrame functions are used. Every shingle is hashed once; the top bits
of the hash choose a bin and the smallest hash of a bin stands for it. Empty
bins are filled by optimal densification: each goes through a fixed random
sequence of bins, its own, until it meets a filled one, and takes its value.
The low bits of the values, packed as two hex digits a bin, are the
fingerprint. Two fingerprints agree in a bin with the similarity's
probability, or by chance; the estimate takes the chance out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import words_of
from tidemark.session import checkpointed

WORDS = 5
BINS = 256
#: Low bits kept of a value.
BITS = 8
#: Steps of a bin's sequence that are tried before the nearest filled bin is looked for among all.
_STEPS = 24
#: Documents in a bucket of the ordering, at least, and number of buckets, about, at most.
_BUCKET_ROWS = 1000
_BUCKETS = 16_000


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of words; a shorter sequence that has words is one."""
    last = F.size(words) - size
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(last >= 0, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_fingerprint(rows: DataFrame, text_col: str, out_col: str, words: int = WORDS) -> DataFrame:
    """The rows with the low bits of all bins as array<tinyint>; empty if the text has no words."""
    width = BINS.bit_length() - 1
    # The largest hash of every bin: a bin that shows it is empty.
    marks = _longs([((b - BINS // 2 + 1) << (64 - width)) - 1 for b in range(BINS)])
    staged = rows.withColumn("__words", words_of(F.col(text_col))).withColumn("__hashes", _shingles(F.col("__words"), words)).drop("__words")
    staged = staged.withColumn("__sorted", F.when(F.size("__hashes") > 0, F.array_sort(F.concat("__hashes", marks)))).drop("__hashes")
    high = lambda h: F.shiftright(h, 64 - width)
    firsts = F.filter("__sorted", lambda h, i: (i == 0) | (high(h) != high(F.get(F.col("__sorted"), i - 1))))
    staged = staged.withColumn("__bins", firsts).drop("__sorted")
    empty = lambda h: F.shiftleft(h, width) == F.lit(-(1 << width))

    def dense(h, i):
        tries = [h]
        for step in range(1, _STEPS + 1):
            # Odd factors, so every step is a permutation of the bins.
            at = ((i + step) * (2 * ((step * 7919) % (BINS // 2)) + 1) + step * step * 31) % BINS
            tries.append(F.get(F.col("__bins"), at.cast("int")))
        values = [F.when(~empty(t), t) for t in tries]
        rest = F.filter(F.col("__bins"), lambda x: ~empty(x))
        # Few bins are filled then: the one that a hash of both puts first.
        values.append(F.array_min(F.transform(rest, lambda x: F.struct(F.xxhash64(x, i).alias("by"), x.alias("x"))))["x"])
        return F.coalesce(*values)

    low = F.transform(F.transform("__bins", dense), lambda h: (h.bitwiseAND(F.lit((1 << BITS) - 1)) - (1 << BITS - 1)).cast("tinyint"))
    return staged.withColumn(out_col, F.coalesce(low, F.array().cast("array<tinyint>"))).drop("__bins")


def packed(bins: Column) -> Column:
    """The fingerprint as text: two hex digits a bin."""
    digits = F.split(F.lit(",".join(f"{i:02x}" for i in range(1 << BITS))), ",")
    return F.array_join(F.transform(bins, lambda b: F.get(digits, b.cast("int") + (1 << BITS - 1))), "")


def likeness(one: Column, two: Column) -> Column:
    """Estimated similarity of the shingle sets, 0 to 1; two texts without words are alike."""
    agree = F.size(F.filter(F.zip_with(one, two, lambda a, b: a == b), lambda same: same)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))
    return F.when((F.size(one) == 0) & (F.size(two) == 0), 1.0).when((F.size(one) == 0) | (F.size(two) == 0), 0.0).otherwise(estimate)


def _bucket(order: Column, edges: list, parts: int) -> Column:
    """Ascending number of a bucket: between which edges, and where between them."""
    edges = [F.lit(float(e)) for e in edges]
    value = order.cast("double")
    known = F.array(*edges)
    at = F.least(F.size(F.filter(known, lambda e: e <= value)), F.lit(len(edges) - 1))
    low, high = F.element_at(known, at), F.element_at(known, at + 1)
    share = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
    inner = F.least(F.lit(parts - 1), F.floor(share * parts))
    return F.when(order.isNull(), F.lit(-1)).otherwise((at - 1) * parts + inner).cast("long")


def with_next(docs: DataFrame, id_col: str, text_col: str, carry=lambda rows: rows) -> DataFrame:
    """Every document (doc_id, text, what `carry` adds) with the next one in
    descending order of ids as the struct `next`; the first follows the last.

    Ids are ordered by quantiles of all ids into buckets, and each bucket gets
    the first document of the next one as a guest, so texts move once and no
    task holds more than a bucket. Nulls come last; equal ids are ordered by a
    hash of the text.
    """
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    rows = docs.count()
    cuts = 32
    edges = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / cuts for i in range(cuts + 1)], 10_000).alias("e")).first().e or [0, 0]
    parts = -(-rows // max(_BUCKET_ROWS, rows // _BUCKETS)) // cuts + 1
    placed = plain.withColumn("bucket", _bucket(F.col("doc_id"), sorted(set(edges)) if len(set(edges)) > 1 else [edges[0], edges[0]], parts)).withColumn(
        "tie", F.xxhash64("text")
    )
    rank = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "tie")
    firsts = placed.groupBy("bucket").agg(F.max(rank).alias("first"))
    # One row for each bucket.
    following = Window.orderBy(F.col("bucket").asc())
    guests = checkpointed(firsts.withColumn(
        "host", F.coalesce(F.lead("bucket").over(following), F.min("bucket").over(Window.partitionBy()))
    ).select(F.col("bucket").alias("from"), "host", "first"))
    same = (F.col("bucket") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    guest_rows = placed.join(guests, same).select("doc_id", "text", F.col("host").alias("bucket"), "tie", F.lit(True).alias("guest"))
    # Equal rows can each be the first; one is enough.
    guest_rows = guest_rows.dropDuplicates(["bucket"])
    whole = carry(placed.withColumn("guest", F.lit(False)).union(guest_rows))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    kept = [c for c in whole.columns if c not in ("bucket", "tie", "guest")]
    return whole.withColumn("next", F.lead(F.struct(*kept)).over(order)).filter("NOT guest").select(*kept, "next")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Fingerprints of all texts and of edited texts.

    The edited text has its last floor(n_chars / 2) code points replaced by as
    many first ones (or all) of the next document, in descending order of ids,
    the last being followed by the first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. Texts without words have the empty fingerprint;
    two of them are alike (1), one and another text are not (0). Texts of
    fewer than `words` words are one shingle. A single document follows
    itself. Repeated rows and null ids are documents like others; nulls come
    last. Other columns are not read. An empty table gives an empty result.
    """
    follow = with_next(docs, id_col, text_col, lambda rows: with_fingerprint(rows, "text", "bins", words))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    staged = follow.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "bins", F.col("next.bins").alias("next_bins"), edited.alias("edited")
    )
    staged = with_fingerprint(staged, "edited", "edited_bins", words)
    return staged.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
