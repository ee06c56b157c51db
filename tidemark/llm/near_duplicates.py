"""Near-duplicate documents by fast similarity sketching.

The set of a document is its distinct word shingles as 64-bit hashes. A
sketch has `BANDS * ROWS` coordinates. In round i every element of the set is
thrown, with the value i + hash, into a bin chosen by a hash of round i; a bin
keeps its smallest value. Rounds end when every bin is filled, and after as
many rounds as there are bins, round t + j throws everything into bin j, so a
set of any size fills every coordinate. A coordinate of two sketches agrees
with the probability of the sets' Jaccard similarity, with the concentration
of independent draws. Bands of coordinates then find candidates and the full
sets confirm them.

Documents with equal sets are one class, so exact copies cost one row each.
In a group of many near copies not all pairs are tried:

* Elements that no other candidate holds cannot be shared. A class whose
  shared part is under the threshold's share of its set links to nothing, and
  any pair's similarity is at most what the two shared parts allow.
* Every bucket is first compared with its hub, the member that meets most
  others; that finds most links with one comparison per member.
* What is left are pairs of different components in one bucket. Elements that
  only `RARE` of the classes left have are counted apart. A pair that shares
  none can have in common, of the rest, at most what both have inside the
  bucket's hub and at most what both have outside it. Such pairs are joined
  on the classes of set sizes that the bound leaves possible, and only members
  outside a bucket's largest component look for partners. A pair that shares
  some is found by them, at most `RARE` holders to an element, and stays if
  the shared ones can make up for the rest.

No pair that shares a bucket is given up unless the bound refutes it, so a
link at the threshold is missed with a probability of about 3e-6 (by no
common band), for the production values.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, components
from tidemark.llm.hashing import many_word_hashes, mix, word_hashes
from tidemark.session import checkpointed, release

BANDS = 32
ROWS = 5
_UNFILLED = np.uint64(2**64 - 1)
#: Holders up to which an element is rare.
RARE = 12
#: Bytes of the texts whose sets and sketches are made together.
_GROUP_BYTES = 1 << 20
#: Width of a class of set sizes, as a factor.
_STEP = 1.05


@lru_cache(maxsize=None)
def _places(words: int) -> list[np.uint64]:
    """An odd factor for each place in a shingle."""
    return list(mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1))


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _runs_of(one: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` of these word hashes."""
    rows = len(one) - size + 1
    whole = np.full(rows, np.uint64(size))
    for i, place in enumerate(_places(size)):
        whole += one[i : i + rows] * place
    return mix(whole)


def _distinct(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    return hashes[np.r_[True, hashes[1:] != hashes[:-1]]] if len(hashes) else hashes


def _shingles(found: list[np.ndarray], words: int) -> list[np.ndarray]:
    """Shingle sets of texts, from their word hashes."""
    joined, out, end = np.concatenate(found) if found else np.empty(0, np.uint64), [], 0
    whole = _runs_of(joined, words) if len(joined) >= words else None
    for one in found:
        end += len(one)
        if len(one) >= words:
            out.append(_distinct(whole[end - len(one) : end - words + 1]))
        else:
            out.append(_runs_of(one, len(one)) if len(one) else one)
    return out


def _groups(texts: list[bytes], words: int):
    """(from, to, word hashes, shingle sets) of neighbouring texts of `_GROUP_BYTES` at most, or of one text."""
    at = 0
    while at < len(texts):
        size, upto = len(texts[at]), at + 1
        while upto < len(texts) and size + len(texts[upto]) <= _GROUP_BYTES:
            size += len(texts[upto])
            upto += 1
        found = many_word_hashes(texts[at:upto])
        yield at, upto, found, _shingles(found, words)
        at = upto


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; a shorter text that
    has words is one shingle, others have none."""
    return _shingles([word_hashes(_lower(text))], words)[0]


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of `bins` filled coordinates for each set; empty sets stay unfilled."""
    sizes = np.array([len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    base = np.repeat(np.arange(len(sets)) * bins, sizes)
    out = np.full(len(sets) * bins, _UNFILLED)
    for i in range(2 * bins):
        if not len(items):
            break
        thrown = mix(items + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1))
        if i < bins:
            at = base + ((thrown >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).view(np.int64)
        else:
            at = base + (i - bins)
        # What an earlier round has filled stays.
        if i:
            free = np.flatnonzero(out[at] == _UNFILLED)
            at, thrown = at[free], thrown[free]
        np.minimum.at(out, at, (np.uint64(i) << np.uint64(48)) | (thrown & np.uint64(2**48 - 1)))
        open_ = (out.reshape(-1, bins) == _UNFILLED).any(axis=1)
        if i < 4 or not i % 8:  # those that are full only wait
            going = np.repeat(open_, sizes)
            items, base, sizes = items[going], base[going], np.where(open_, sizes, 0)
        elif not open_[sizes > 0].any():
            break
    return out.reshape(-1, bins)


def _band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    cells = rows.reshape(len(rows), bands, -1)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(rows), 1))
    for i in range(cells.shape[2]):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + cells[:, :, i])
    return keys.view(np.int64)


def _features(words: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            texts = [_lower(t) for t in batch.column(1).to_pylist()]
            for at, upto, found, sets in _groups(texts, words):
                keys = _band_keys(sketches(sets, bands * rows), bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at:upto], batch.column(2)[at:upto],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([k if len(s) else [] for s, k in zip(sets, keys)], pa.list_(pa.int64())),
                        pa.array([len(f) for f in found], pa.int64()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "cls", "keys", "n_words"],
                )

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for at, upto, _, sets in _groups([_lower(t) for t in batch.column(1).to_pylist()], words):
                items = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:upto], items], names=["cls", "items"])

    return run


def _agree(percent: int):
    """Whether 100 * common >= percent * union, on full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                one, two = one.values.to_numpy(), two.values.to_numpy()
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a"))
    two = sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "items_a", "items_b")
    return checkpointed(joined.mapInArrow(_agree(percent), "a binary, b binary"))


def _inside(batches):
    """Elements of a set without its rare ones, and those of them that its hub has."""
    for batch in batches:
        m, inside = [], []
        for own, rare, hub in zip(batch.column(2), batch.column(3), batch.column(4)):
            items = own.values.to_numpy()
            if rare.is_valid:
                items = np.setdiff1d(items, rare.values.to_numpy())
            m.append(len(items))
            inside.append(len(np.intersect1d(items, hub.values.to_numpy())))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(m, pa.int64()), pa.array(inside, pa.int64())], names=["cls", "hub", "m", "inside"]
        )


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def _size_class(n):
    return F.floor(F.log(n) / math.log(_STEP))


def _most(shared: str, n: str, percent: int):
    """The largest set that a set of n elements can be alike, if only `shared` of them can be common."""
    return F.floor((100 + percent) * F.col(shared) / percent) - F.col(n)


def _class_links(buckets: DataFrame, sets: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect all classes which links connect."""
    alone = (
        sets.select("cls", F.explode("items").alias("item")).groupBy("item")
        .agg(F.min("cls").alias("cls"), F.max("cls").alias("last")).filter("cls = last")
        .groupBy("cls").agg(F.count("*").alias("alone"))
    )
    shared = sets.select("cls").distinct().join(alone, "cls", "left")
    central = buckets.groupBy("cls").agg(F.sum("size").alias("central"), F.first("n").alias("n"))
    bounds = (
        central.join(shared, "cls").withColumn("m", F.col("n") - F.coalesce("alone", F.lit(0)))
        .filter(100 * F.col("m") >= percent * F.col("n"))
        # The largest set that can still be alike.
        .withColumn("most", _most("m", "n", percent))
        .select("cls", "n", "most", "central")
    )
    members = checkpointed(buckets.select("key", "cls").join(bounds, "cls"))

    hubs = members.groupBy("key").agg(F.max(F.struct("central", "cls", "n", "most")).alias("hub"), F.count("*").alias("k")).filter("k > 1")
    hubs = hubs.select("key", F.col("hub.cls").alias("other"), F.col("hub.n").alias("other_n"), F.col("hub.most").alias("other_most"))
    tried = checkpointed(_pairs(members.join(hubs, "key").filter("cls <> other AND n <= other_most AND other_n <= most")))
    first = _confirmed(tried, sets, percent)

    labels = components(first)
    labelled = checkpointed(
        members.join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left")
        .select("key", "cls", "n", "most", F.coalesce("root", "cls").alias("label"))
    )
    largest = (
        labelled.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key")
        .agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
        .select("key", F.col("top.label").alias("largest"))
    )
    open_ = checkpointed(labelled.join(largest, "key"))
    if open_.isEmpty():  # every bucket is one component
        release(open_)
        return first

    # Among what is left, elements that few have: counted out of every bound, and pairs that share some found by them.
    left = checkpointed(open_.select("cls", "n", "label").distinct())
    spread = sets.join(left, "cls").select("cls", "n", "label", F.explode("items").alias("item"))
    few = spread.groupBy("item").agg(F.count("*").alias("holders")).filter(F.col("holders") <= RARE).select("item")
    rare = checkpointed(spread.join(few, "item"))
    # Each against its buckets' hubs: how many other elements are in the hub's set.
    rare_of = rare.groupBy("cls").agg(F.collect_list("item").alias("rare"))
    against = open_.join(hubs.select("key", F.col("other").alias("hub")), "key")
    compared = (
        against.select("cls", "hub").distinct().join(sets, "cls").join(rare_of, "cls", "left")
        .join(sets.select(F.col("cls").alias("hub"), F.col("items").alias("hub_items")), "hub")
        .select("cls", "hub", "items", "rare", "hub_items")
    )
    inside = checkpointed(compared.mapInArrow(_inside, "cls binary, hub binary, m long, inside long"))
    common = checkpointed(inside.select("cls", "m").distinct())
    # Pairs that share no such element, each in the first bucket it shares.
    bounded = against.drop("most").join(inside, ["cls", "hub"]).join(keys, "cls").withColumn("most", _most("m", "n", percent)).select(
        "key", "cls", "label", "largest", "n", "most", "inside", (F.col("m") - F.col("inside")).alias("outside"), "keys"
    )
    lowest, highest = F.ceil(percent * F.col("n") / 100), F.least("most", F.floor(100 * F.col("n") / percent))
    seekers = bounded.filter("label <> largest").withColumn("low", lowest).withColumn("high", highest).filter("low <= high").select(
        "key", F.explode(F.sequence(_size_class(F.col("low")), _size_class(F.col("high")))).alias("size_class"),
        *(F.col(c).alias("other" if c == "cls" else f"other_{c}") for c in ("cls", "label", "n", "most", "inside", "outside", "keys")),
    )
    met_first = F.get(F.col("keys"), (F.array_position(F.zip_with("keys", "other_keys", lambda a, b: a == b), True) - 1).cast("int"))
    apart = _pairs(
        bounded.withColumn("size_class", _size_class(F.col("n"))).join(seekers, ["key", "size_class"])
        .filter(
            (F.col("label") != F.col("other_label")) & F.expr("n <= other_most AND other_n <= most")
            & F.expr(f"{100 + percent} * (least(inside, other_inside) + least(outside, other_outside)) >= {percent} * (n + other_n)")
            & (met_first == F.col("key"))
        )
    )
    # Pairs that share some: enough of them to make up for the rest.
    one, two = (rare.select("item", *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "label"))) for x in "ab")
    meeting = one.join(two, "item").filter(
        f"cls_a < cls_b AND label_a <> label_b AND 100 * n_a >= {percent} * n_b AND 100 * n_b >= {percent} * n_a"
    ).groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg(F.count("*").alias("both"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    enough = (
        meeting.join(common.select(F.col("cls").alias("a"), F.col("m").alias("m_a")), "a").join(common.select(F.col("cls").alias("b"), F.col("m").alias("m_b")), "b")
        .filter(f"{100 + percent} * (least(m_a, m_b) + both) >= {percent} * (n_a + n_b)").select("a", "b")
    )
    rest = checkpointed(apart.union(enough).distinct().join(tried, ["a", "b"], "left_anti"))
    return first if rest.isEmpty() else first.union(_confirmed(rest, sets, percent))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS, with_texts: bool = False,
) -> DataFrame:
    """Components of documents whose shingle sets are alike.

    Returns one row per input row: doc_id, n_shingles, component_id (the
    smallest id reachable by links, its own included), kept (doc_id =
    component_id; of different texts of a component with that id, the one with
    the smallest hash). `with_texts` adds text_hash (xxhash64 of the text) and
    component (a digest, null without words), which tell rows and components
    apart where ids are null or come more than once, and n_words.

    Null and empty texts and texts without words have an empty set and are
    linked to nothing. Equal texts are always linked. Repeated rows come out
    as often as they came in. A row without id takes its component's smallest
    id and is not kept, unless no row of the component has an id: then
    component_id is null and the rows of one text are kept. Other columns of the input are not
    read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )
    features = checkpointed(plain.mapInArrow(
        _features(words, bands, rows), "doc_id long, text_hash long, n_shingles long, cls binary, keys array<long>, n_words long"
    ))
    classes = checkpointed(features.filter("n_shingles > 0").groupBy("cls").agg(
        # Rows without id come last.
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row"),
        F.first("n_shingles").alias("n"), F.first("keys").alias("keys"),
    ))
    posted = checkpointed(classes.select("cls", "n", F.explode("keys").alias("key")))
    crowded = posted.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = checkpointed(posted.join(crowded, "key"))
    release(posted)
    if buckets.isEmpty():  # no two classes meet
        return _named(features, classes.select("cls", F.col("cls").alias("root"), F.col("row").alias("smallest")), with_texts)

    # The text of one row of each class that meets another is read again.
    wanted = classes.join(buckets.select("cls").distinct(), "cls", "left_semi").select(
        "cls", F.col("row.doc_id").alias("row_id"), F.col("row.text_hash").alias("row_hash")
    )
    texts = plain.join(wanted, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("text_hash") == F.col("row_hash"))).select("cls", "text")
    sets = checkpointed(texts.mapInArrow(_sets(words), "cls binary, items array<long>"))

    roots = components(_class_links(buckets, sets, classes.select("cls", "keys"), percent)).select(F.col("node").alias("cls"), "root")
    whole = classes.select("cls", "row").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = checkpointed(
        whole.join(whole.groupBy("root").agg(F.min("row").alias("smallest")), "root").select("cls", "root", "smallest")
    )
    return _named(features, named, with_texts)


def _named(features: DataFrame, named: DataFrame, with_texts: bool) -> DataFrame:
    """Rows with the root and the smallest row of their component."""
    first = F.col("doc_id").eqNullSafe(F.col("smallest.doc_id")) & (F.col("text_hash") == F.col("smallest.text_hash"))
    found = features.drop("keys").join(named, "cls", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("smallest.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, first).otherwise(True).alias("kept"), "text_hash", F.col("root").alias("component"),
        "n_words",
    )
    return found if with_texts else found.drop("text_hash", "component", "n_words")
