"""Documents that hold passages of a benchmark, by SimHash of item-sized windows.

Only DataFrame functions are used. An item of n words is compared with windows
of n words of every document, as sets of word shingles with multiplicity.

1. A window shares nothing with an item unless shingles of the item start in
   it. Each document's shingle hashes are looked up in a bitmap of the items'
   shingles (for benchmarks up to `BITMAP_SHINGLES`; larger ones are joined).
   A window that could reach the similarity holds at least one of the item's
   marks, as many of its rarest shingles among items as it may lack and one
   more, so a shingle that many items share pairs nothing by itself. Of a pair
   of a document and an item that meet in a mark, the windows that begin at a
   shingle of the item, or end with the document, and hold enough of them are
   looked at; any other can be moved to one of these. This loses nothing.
2. Windows and items get 64-bit SimHash fingerprints. Fingerprints are cut
   into more blocks than the radius has bits, so two within the radius agree
   in a block; windows and their items are joined on item, block number and
   block, once for the first block they agree in, and kept within the radius.
   The default radius lies more than four deviations beyond the distance that
   is expected at the threshold. Repeats of a shingle are numbered in their
   window and hashed with the number, so each counts on its own and none
   outweighs the others; the weighted similarity is that of plain sets.
3. Candidates are confirmed by the similarity of the weighted shingle sets:
   the sum of the smaller multiplicities over the sum of the larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, words_of
from tidemark.session import checkpointed

WORDS = 5
PERCENT = 80
RADIUS = 23
#: Distinct item shingles up to which their bitmap is part of the plan (2**20 bits).
BITMAP_SHINGLES = 200_000
_BITS = 1 << 20


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of `size` words, in order."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[words[i + k] for k in range(size)]))).otherwise(
        F.array().cast("array<bigint>")
    )


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of radius + 1 blocks that make up 64 bits."""
    count = radius + 1
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block(fingerprint: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and, in the array h, the shingles of each row with their repeats told
    apart: the first of equals as it is, the others hashed with their number."""
    parts = held(rows.select(*keys, F.array_sort("shingles").alias("h")), "h")
    last = F.size("h") - 1
    first = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(F.col("h"), i) != F.get(F.col("h"), i - 1)))
    parts = held(parts.withColumn("first", F.when(F.size(F.array_distinct("h")) < F.size("h"), first)), "first")
    runs = F.transform(F.col("first"), lambda at, i: F.struct(at.alias("at"), (F.coalesce(F.get(F.col("first"), i + 1), last + 1) - at).alias("times")))
    told = F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(F.lit(0), r["times"] - 1), lambda k: F.when(k == 0, F.get(F.col("h"), r["at"])).otherwise(F.xxhash64(F.get(F.col("h"), r["at"]), k))
    )))
    return parts.select(*keys, F.when(F.col("first").isNull(), F.col("h")).otherwise(told).alias("h"))


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of the array `shingles` of each row: per bit, whether more of its shingles,
    repeats told apart, have it set in their hash than not."""
    bits = _numbered(rows, keys).select(*keys, F.explode("h").alias("h")).groupBy(*keys).agg(
        *[F.sum(F.when(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1).cast("long")) == 1, 1).otherwise(-1)).alias(f"b{b}") for b in range(64)]
    )
    whole = F.lit(0).cast("long")
    for b in range(64):
        whole = whole.bitwiseOR(F.shiftleft(F.when(F.col(f"b{b}") > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")), b))
    return bits.select(*keys, whole.alias("fingerprint"))


def _common(one: str, two: str) -> Column:
    """Sum of the smaller multiplicities of two arrays."""
    a, b = F.col(one), F.col(two)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    both = F.array_intersect(a, b)
    many = F.aggregate(both, F.lit(0), lambda acc, v: acc + F.least(times(a, v), times(b, v)))
    return F.when(plain, F.size(both)).otherwise(many)


def _item_shingles(items: DataFrame, size: int) -> DataFrame:
    return items.select("item_id", "n", F.explode(_shingles(F.col("words"), size)).alias("h"))


def _bitmap(hashes: DataFrame) -> Column | None:
    """Bitmap of the hashes' low bits as a literal; none if there are too many."""
    found = [r.h for r in hashes.distinct().limit(BITMAP_SHINGLES + 1).collect()]
    if len(found) > BITMAP_SHINGLES:
        return None
    cells = [0] * (_BITS // 64)
    for h in found:
        cells[h % _BITS >> 6] |= 1 << (h & 63)
    signed = ",".join(str(c - (1 << 64) if c >> 63 else c) for c in cells)
    return F.split(F.lit(signed), ",").cast("array<bigint>")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, percent: int = PERCENT, radius: int = RADIUS,
    by_text: bool = False,
) -> DataFrame:
    """Items found in documents: doc_id, item_id, similarity (of the best
    window), start (its first word, from 0; the first of equals), n_words (of the item).

    Words are runs of letters and digits, lower-cased. Items of fewer than
    `words` words are one shingle; items and documents without words match
    nothing; a document shorter than an item is one window. Rows with equal id
    and text are one document, items with equal id and text one item; a null
    id is an id like any other. `by_text` tells the texts of one id apart
    and adds text_hash (xxhash64 of the text). Other columns are not read.
    Empty tables give an empty result.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    items = items.withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words")).filter("n > 0")
    items = checkpointed(items.select("item_id", "n", "words"))
    sizes = [r.s for r in items.select(F.least("n", F.lit(words)).alias("s")).distinct().orderBy("s").collect()]
    keys = ["doc_id", "text_hash"] if by_text else ["doc_id"]
    found = [_found(plain, items.filter(F.least("n", F.lit(words)) == s), s, percent, radius, keys) for s in sizes]
    if not found:
        empty = plain.withColumn("text_hash", F.xxhash64("text")).join(items.withColumnRenamed("n", "n_words"), F.lit(False)).select(
            *keys, "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), "n_words"
        )
        return empty
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole


def _found(plain: DataFrame, items: DataFrame, size: int, percent: int, radius: int, keys: list[str]) -> DataFrame:
    shingles = checkpointed(_item_shingles(items, size))
    bitmap = _bitmap(shingles.select("h"))
    hashed = plain.withColumn("words", words_of(F.col("text"))).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), _shingles(F.col("words"), size).alias("h")
    )
    hashed = held(hashed, "h")
    if bitmap is not None:
        def known(h):
            cell = F.get(bitmap, F.shiftrightunsigned(h.bitwiseAND(F.lit(_BITS - 1)), 6).cast("int"))
            return F.call_function("shiftrightunsigned", cell, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

        where = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: known(F.get(F.col("h"), i)))
        hashed = held(hashed.filter(F.size("h") > 0).withColumn("hits", where), "hits")
    else:
        # Too many items for a bitmap: one join of all shingles, aggregated by document.
        spots = hashed.select("doc_id", "text_hash", F.posexplode("h").alias("at", "x")).join(
            shingles.select(F.col("h").alias("x")).distinct(), "x", "left_semi"
        ).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("hits")).withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
        hashed = hashed.join(spots, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).drop("d", "t")
    # A window of any size that is similar to an item holds this many hits; documents without go before their
    # shingles are moved.
    lengths = [r.m for r in items.select((F.col("n") - size + 1).alias("m")).distinct().orderBy("m").collect()]
    fewest = max(1, -(-percent * lengths[0] // 100))
    dense = F.exists(
        F.sequence(F.lit(0), F.size("hits") - fewest),
        lambda j: F.get(F.col("hits"), j + fewest - 1) < F.get(F.col("hits"), j) + lengths[-1],
    )
    hit = checkpointed(hashed.filter((F.size("hits") >= fewest) & F.when(F.size("hits") >= fewest, dense)).select("doc_id", "text_hash", "h", "hits").dropDuplicates(["doc_id", "text_hash"]))

    # Per item its shingles and its marks: so many of the rarest among items that a similar window holds one.
    shared = shingles.groupBy("h").agg(F.count_distinct("item_id", "n").alias("df"))
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("df", "h"))), lambda x: x["h"])
    own = shingles.join(shared, "h").groupBy("item_id", "n").agg(rarest.alias("item_shingles")).withColumn("m", F.size("item_shingles"))
    spare = F.col("m") - F.ceil(F.col("m") * F.lit(percent) / F.lit(100.0) - 1e-9) + 1
    own = checkpointed(own.withColumn("item", F.xxhash64("item_id", "item_shingles")).withColumn("marks", F.slice("item_shingles", 1, spare.cast("int"))))
    marks = own.select("item", F.explode("marks").alias("x")).distinct()
    values = F.array_distinct(F.transform("hits", lambda at: F.get(F.col("h"), at)))
    pairs = checkpointed(
        hit.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.explode(values).alias("x"))
        .join(marks, "x").select("d", "t", "item").distinct()
    )

    # Windows of a document for an item that begin at one of its shingles and hold enough of them.
    met = pairs.join(own.select("item", "m", "item_shingles"), "item").join(
        hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    )
    spots = held(
        met.withColumn("mine", F.filter("hits", lambda at: F.array_contains("item_shingles", F.get(F.col("h"), at))))
        .select("doc_id", "text_hash", "item", "m", "h", "mine", F.least("m", F.size("h")).alias("w")), "mine",
    ).withColumn(
        # At similarity percent, 100 * common >= percent * (m + w - common).
        "least", F.ceil(F.lit(percent) * (F.col("m") + F.col("w")) / F.lit(100.0 + percent) - 1e-9).cast("int")
    ).filter("least <= w AND size(mine) >= least")
    rich = F.filter(
        F.sequence(F.lit(0), F.size("mine") - F.col("least")),
        lambda j: F.get(F.col("mine"), j + F.col("least") - 1) < F.get(F.col("mine"), j) + F.col("w"),
    )
    # Equal windows at a document's end are one.
    starts = F.array_distinct(F.transform(rich, lambda j: F.least(F.get(F.col("mine"), j), F.size("h") - F.col("w"))))
    cut = checkpointed(
        spots.withColumn("start", F.explode(starts))
        .select("doc_id", "text_hash", "item", "start", F.slice("h", F.col("start") + 1, F.col("w")).alias("shingles"))
        .withColumn("window", F.xxhash64("doc_id", "text_hash", "item", "start"))
    )
    windows = _fingerprints(cut, ["window", "item"])
    items_marked = _fingerprints(own.select("item", F.col("item_shingles").alias("shingles")), ["item"]).withColumnRenamed("fingerprint", "item_fingerprint")

    blocks = _blocks(radius)

    def posted(rows, name):
        values = F.array(*[_block(F.col(name), low, bits) for low, bits in blocks])
        return rows.select("*", F.posexplode(values).alias("block", "value"))

    # Only fingerprints are posted; shingles are fetched for the windows that stay.
    differs = F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))
    first = F.array_position(F.array(*[_block(differs, low, bits) == 0 for low, bits in blocks]), True) - 1
    candidates = posted(windows, "fingerprint").join(posted(items_marked, "item_fingerprint"), ["item", "block", "value"]).filter(
        (first == F.col("block")) & (F.bit_count(differs) <= radius)
    ).select("window")
    near = cut.join(candidates, "window", "left_semi").join(own.select("item", "item_id", "n", "item_shingles"), "item")
    alike = near.withColumn("common", _common("shingles", "item_shingles")).withColumn(
        "whole", F.size("shingles") + F.size("item_shingles") - F.col("common")
    ).filter(100 * F.col("common") >= percent * F.col("whole"))
    best = F.struct((F.col("common") / F.col("whole")).alias("similarity"), (-F.col("start")).alias("start"))
    return alike.groupBy(*keys, "item_id", "n").agg(F.max(best).alias("best")).select(
        *keys, "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.start")).alias("start"), F.col("n").alias("n_words")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents in which no item was found, with all their columns; others of the same or no id stay."""
    found = contaminated(docs, benchmark, id_col, text_col, by_text=True, **options)
    bad = checkpointed(found.select(F.col("doc_id").alias("__bad"), F.col("text_hash").alias("__text")).distinct())
    same = F.xxhash64(docs[text_col].cast("string")) == F.col("__text")
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__bad")) & same, "left_anti")
