"""Removal of long byte strings that occur more than once in a corpus.

A byte goes if it lies in a string of `length` bytes that also starts anywhere
else, in the same document or another. Such a string is called a window.

1. Equal texts are one class; all windows of a text with copies repeat.
2. Every window has an anchor: of all its k-grams the one with the smallest
   hash, the leftmost of equals. Equal windows have equal anchors at equal
   offsets. Neighbouring windows with one anchor form a run, which is about
   half a window long, so a corpus has few runs. Runs with equal bytes repeat
   as a whole and are settled by counting digests; runs whose anchor hash
   nobody shares are settled as unique. Both counts are combined before they
   are shuffled, so a passage that a third of all documents share is counted
   like any other.
3. Left are the edges of repeated passages: runs that share their anchor but
   not all bytes. Their bytes are read again, one copy of each different run,
   and brought together by anchor. What stands right of the anchor, and in
   reverse what stands left of it, is suffix-sorted by deep-shallow sorting:
   multikey quicksort to `SHALLOW` bytes, then a blind trie for each group
   that still agrees there. The common prefixes of neighbours in both orders
   say which windows at which offset are equal.
4. An anchor with more than `CROWD` different runs is too much for one task.
   Its windows are counted one by one by their digests instead, a shuffle
   that any number of tasks share; the result is the same.

Passages are runs of a number of words that another document has too, however
many bytes they are; white space between words does not matter. Their windows
have anchors like those of bytes. Only windows whose anchor two different texts
have are counted, one by one, by their hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.llm.hashing import hash_sums, many_word_hashes, part_hashes, prefix_sums, word_bounds, word_hashes
from tidemark.session import checkpointed

#: Bytes up to which multikey quicksort compares.
SHALLOW = 16
#: Different runs of one anchor that one task sorts.
CROWD = 2000
#: Groups up to this size compare their members through the sorted orders;
#: larger ones number the classes of each depth.
_FEW = 24
_BLOCK = 1 << 20
_POSITION = np.uint64(21)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


# --- anchors and runs -------------------------------------------------------


def _gram(length: int) -> int:
    return max(1, min(48, length // 4))


def _runs_of_block(data: np.ndarray, ends: np.ndarray, length: int):
    """Runs of the windows in joined texts: starts, window counts, anchors, anchor hashes.

    `ends` holds for each byte the end of its text."""
    return _runs_of_sums(prefix_sums(data), ends, length, _gram(length))


def _runs_of_sums(sums: np.ndarray, ends: np.ndarray, length: int, gram: int):
    size = len(sums) - 1
    if size < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    starts = np.arange(size - gram + 1)
    marks = part_hashes(sums, starts, starts + gram)
    marks = (marks >> _POSITION << _POSITION) | starts.astype(np.uint64)
    wide, windows = length - gram + 1, size - length + 1
    padded = np.full(-(-len(marks) // wide) * wide, np.uint64(2**64 - 1))
    padded[: len(marks)] = marks
    cells = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(cells, axis=1).reshape(-1)
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    lowest = np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows])
    at = np.arange(windows)
    valid = at + length <= ends[:windows]
    anchors = np.where(valid, (lowest & np.uint64((1 << 21) - 1)).astype(np.int64), -1)
    first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    count = np.diff(np.r_[first, windows])
    keep = anchors[first] >= 0
    first, count = first[keep], count[keep]
    return first, count, anchors[first], lowest[first] >> _POSITION


def text_runs(texts: list[bytes], length: int) -> list[tuple[list, list, list, list, list]]:
    """For each text its runs: start, number of windows, anchor, anchor hash and digest."""
    out = [([], [], [], [], []) for _ in texts]
    pieces = []  # (text, offset of the piece in it, bytes), no window in two pieces
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), _BLOCK):
            pieces.append((i, at, t[at : at + _BLOCK + length - 1]))
    at = 0
    while at < len(pieces):
        size, upto = len(pieces[at][2]), at + 1
        while upto < len(pieces) and size + len(pieces[upto][2]) <= _BLOCK + length:
            size += len(pieces[upto][2])
            upto += 1
        here = pieces[at:upto]
        joined = b"".join(p[2] for p in here)
        sizes = np.array([len(p[2]) for p in here])
        stops = np.cumsum(sizes)
        first, count, anchor, key = _runs_of_block(np.frombuffer(joined, np.uint8), np.repeat(stops, sizes), length)
        owner = np.searchsorted(stops, first, side="right")
        for f, c, a, k, o in zip(first.tolist(), count.tolist(), anchor.tolist(), key.tolist(), owner.tolist()):
            text, offset, piece = here[o]
            shift = offset - int(stops[o]) + len(piece)
            rows = out[text]
            rows[0].append(f + shift)
            rows[1].append(c)
            rows[2].append(a + shift)
            rows[3].append(k)
            rows[4].append(hashlib.blake2b(joined[f : f + c - 1 + length], digest_size=16).digest())
        at = upto
    return out


# --- passages of words -------------------------------------------------------


def word_runs(found: list[np.ndarray], words: int):
    """Runs of the windows of `words` words of texts, given as word hashes: arrays of text, start, windows, anchor hash."""
    pieces = [(i, at, f[at : at + _BLOCK + words - 1]) for i, f in enumerate(found) for at in range(0, max(1, len(f) - words + 1), _BLOCK)]
    at = 0
    while at < len(pieces):
        size, upto = len(pieces[at][2]), at + 1
        while upto < len(pieces) and size + len(pieces[upto][2]) <= _BLOCK:
            size += len(pieces[upto][2])
            upto += 1
        here = pieces[at:upto]
        sizes = np.array([len(p[2]) for p in here])
        stops = np.cumsum(sizes)
        sums = hash_sums(np.concatenate([p[2] for p in here]))
        first, count, _, key = _runs_of_sums(sums, np.repeat(stops, sizes), words, max(1, min(6, words // 8)))
        owner = np.searchsorted(stops, first, side="right")
        yield np.array([p[0] for p in here])[owner], first + (np.array([p[1] for p in here]) - stops + sizes)[owner], count, key.view(np.int64)
        at = upto


def _marks(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Distinct anchor hashes of each text's windows of words."""
    runs = list(word_runs(many_word_hashes(texts), words))
    text, key = (np.concatenate([r[i] for r in runs]) for i in (0, 3))
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])][: len(text)])
    return np.split(key[new], np.searchsorted(text[new], np.arange(1, len(texts))))


def _windows(data: bytes, words: int, marks: np.ndarray | None = None):
    """(start, hashes of the windows) of the runs of a text, or of those with one of these anchors."""
    found = word_hashes(data)
    for _, first, count, key in word_runs([found], words):
        chosen = np.isin(key, marks) if marks is not None else np.ones(len(key), bool)
        for f, c in zip(first[chosen].tolist(), count[chosen].tolist()):
            at = np.arange(c)
            yield f, part_hashes(hash_sums(found[f : f + c - 1 + words]), at, at + words).view(np.int64)


def _spared(words: int):
    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, hashes in _windows(_bytes(text), words):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes)], names=["window"])

    return run


_FEATURES = (
    "doc_id long, digest binary, n_bytes long, sha string, "
    "starts array<long>, counts array<int>, anchors array<long>, keys array<long>, contents array<binary>, marks array<long>"
)


def _features(length: int, words: int):
    types = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [_bytes(t) for t in part.column(1).to_pylist()]
                runs = text_runs(texts, length)
                columns = [
                    part.column(0),
                    pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ] + [pa.array([r[i] for r in runs], types[i]) for i in range(5)]
                columns.append(pa.array(_marks(texts, words) if words else [[]] * len(texts), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FEATURES.split(", ")])

    return run


# --- deep-shallow sorting ---------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differs = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differs.bit_length() + 7) // 8


class _Branch:
    """Inner node of a blind trie: strings below agree up to `depth`."""

    __slots__ = ("depth", "ways")

    def __init__(self, depth: int, ways: dict):
        self.depth, self.ways = depth, ways


def _blind_trie(strings: list[bytes], members: list[int], out: list[int], lcps: list[int]) -> None:
    """Append the members in order, with the common prefix of each and the one before."""

    def letter(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    root: object = [members[0]]
    for m in members[1:]:
        s, path, node = strings[m], [], root
        while isinstance(node, _Branch):  # blind: only the branching bytes are looked at
            path.append(node)
            way = letter(s, node.depth)
            node = node.ways[way if way in node.ways else next(iter(node.ways))]
        known = strings[node[0]]
        agree = common_prefix(s, known)
        if agree == len(s) == len(known):
            node.append(m)
            continue
        above = [b for b in path if b.depth <= agree]
        if above and above[-1].depth == agree:
            above[-1].ways[letter(s, agree)] = [m]
            continue
        below = path[len(above)] if len(above) < len(path) else node
        fork = _Branch(agree, {letter(known, agree): below, letter(s, agree): [m]})
        if above:
            above[-1].ways[letter(s, above[-1].depth)] = fork
        else:
            root = fork
    stack: list[tuple[object, int | None]] = [(root, None)]
    while stack:
        node, lcp = stack.pop()
        if isinstance(node, _Branch):
            ways = sorted(node.ways)
            for way in reversed(ways[1:]):
                stack.append((node.ways[way], node.depth))
            stack.append((node.ways[ways[0]], lcp))
            continue
        for i, m in enumerate(node):
            if out:
                lcps.append(lcp if i == 0 and lcp is not None else len(strings[m]) if i else common_prefix(strings[out[-1]], strings[m]))
            out.append(m)


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of strings, and the common prefix of each string in that
    order with the one before it (the first left out)."""
    out: list[int] = []
    lcps: list[int] = []
    depth = min(common_prefix(strings[0], s) for s in strings)
    limit = depth + SHALLOW
    stack = [(list(range(len(strings))), depth)]
    while stack:
        members, at = stack.pop()
        if not members:
            continue
        if len(members) == 1:
            if out:
                lcps.append(common_prefix(strings[out[-1]], strings[members[0]]))
            out.append(members[0])
            continue
        if at >= limit:
            _blind_trie(strings, members, out, lcps)
            continue
        letters = [strings[m][at] if at < len(strings[m]) else -1 for m in members]
        pivot = sorted((letters[0], letters[len(letters) // 2], letters[-1]))[1]
        less = [m for m, c in zip(members, letters) if c < pivot]
        same = [m for m, c in zip(members, letters) if c == pivot]
        more = [m for m, c in zip(members, letters) if c > pivot]
        stack.append((more, at))
        stack.append((same, limit if pivot < 0 else at + 1))
        stack.append((less, at))
    return out, lcps


# --- windows of one anchor --------------------------------------------------


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def equal_windows(bodies: list[bytes], lefts: list[int], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For runs of one anchor, the ranges [from, to) of their windows that
    another run has too. `lefts` are the anchors' places in the bodies."""
    n = len(bodies)
    right = [b[at:] for b, at in zip(bodies, lefts)]
    left = [b[:at][::-1] for b, at in zip(bodies, lefts)]
    (r_order, r_lcp), (l_order, l_lcp) = deep_shallow(right), deep_shallow(left)
    flags = [np.zeros(c, bool) for c in counts]
    if n <= _FEW:
        agree_r, agree_l = {}, {}
        for order, lcps, agree in ((r_order, r_lcp, agree_r), (l_order, l_lcp, agree_l)):
            for i in range(n):
                low = 1 << 60
                for j in range(i + 1, n):
                    low = min(low, lcps[j - 1])
                    agree[min(order[i], order[j]), max(order[i], order[j])] = low
        for (i, j), ahead in agree_r.items():
            # Bytes of the window left of the anchor: at least and at most.
            least, most = max(0, length - ahead), agree_l[i, j]
            least = max(least, lefts[i] - counts[i] + 1, lefts[j] - counts[j] + 1)
            most = min(most, lefts[i], lefts[j])
            if least <= most:
                for m in (i, j):
                    flags[m][lefts[m] - most : lefts[m] - least + 1] = True
        return [_ranges(f) for f in flags]
    lefts_, counts_ = np.array(lefts), np.array(counts)
    r_order, l_order = np.array(r_order), np.array(l_order)
    r_lcp, l_lcp = np.array(r_lcp), np.array(l_lcp)
    for back in range(int((lefts_ - counts_ + 1).min()), int(lefts_.max()) + 1):
        has = (lefts_ >= back) & (lefts_ - back < counts_)
        if has.sum() < 2:
            continue
        classes = np.empty((2, n), np.int64)
        classes[0, r_order] = np.r_[0, np.cumsum(r_lcp < length - back)]
        classes[1, l_order] = np.r_[0, np.cumsum(l_lcp < back)]
        who = np.flatnonzero(has)
        _, place, size = np.unique(classes[0, who] * n + classes[1, who], return_inverse=True, return_counts=True)
        for m in who[size[place] > 1].tolist():
            flags[m][lefts[m] - back] = True
    return [_ranges(f) for f in flags]


_BODIES = "key long, content binary, digest binary, start long, count int, left int, body binary, windows array<binary>, hashes array<long>"


def _bodies(length: int, words: int):
    """Bytes of the wanted runs of a text, or for crowded anchors their windows'
    digests; and hashes of the windows of words that have a shared anchor."""

    def run(batches):
        for batch in batches:
            for digest, text, wanted, marks in zip(*(batch.column(i) for i in range(4))):
                data, rows = _bytes(text.as_py()), []
                for w in wanted.as_py() or []:
                    body = data[w["start"] : w["start"] + w["count"] - 1 + length]
                    windows = None
                    if w["crowd"]:
                        windows = [hashlib.blake2b(body[i : i + length], digest_size=16).digest() for i in range(w["count"])]
                    rows.append({
                        "key": w["key"], "content": w["content"], "digest": digest.as_py(), "start": w["start"], "count": w["count"],
                        "left": w["anchor"] - w["start"], "body": None if w["crowd"] else body, "windows": windows,
                    })
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if marks.is_valid:
                    for start, hashes in _windows(data, words, marks.values.to_numpy()):
                        rows.append({"digest": digest.as_py(), "start": start, "hashes": hashes})
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([
        ("key", pa.int64()), ("content", pa.binary()), ("digest", pa.binary()), ("start", pa.int64()), ("count", pa.int32()),
        ("left", pa.int32()), ("body", pa.binary()), ("windows", pa.list_(pa.binary())), ("hashes", pa.list_(pa.int64())),
    ])
    return run


def _sorted_groups(length: int):
    """Ranges of repeated windows, from rows that come with equal anchors together."""

    def ranges(group: dict[bytes, tuple]):
        rows = list(group.values())
        if len(rows) < 2:
            return []
        found = equal_windows([r[4] for r in rows], [r[3] for r in rows], [r[2] for r in rows], length)
        return [(digest, start + a, b - a) for (digest, start, *_), ranges in zip(rows, found) for a, b in ranges]

    def run(batches):
        current, group = None, {}
        for batch in batches:
            out = []
            keys, contents, *rest = (batch.column(i).to_pylist() for i in range(7))
            for key, content, row in zip(keys, contents, zip(*rest)):
                if key != current:
                    out += ranges(group)
                    current, group = key, {}
                group.setdefault(content, row)
            yield pa.RecordBatch.from_pylist([dict(zip(("digest", "start", "count"), r)) for r in out], schema=schema)
        yield pa.RecordBatch.from_pylist([dict(zip(("digest", "start", "count"), r)) for r in ranges(group)], schema=schema)

    schema = pa.schema([("digest", pa.binary()), ("start", pa.int64()), ("count", pa.int32())])
    return run


# --- the operator -----------------------------------------------------------


def _sharing(features: DataFrame) -> DataFrame:
    """(digest, row_id, marks): the anchors of words that another text has too."""
    posts = features.select("digest", F.explode("marks").alias("mark"))
    met = _of_two_texts(posts, "mark")
    rows = features.groupBy("digest").agg(F.min("doc_id").alias("row_id"))
    return posts.join(met, "mark").groupBy("digest").agg(F.collect_set("mark").alias("marks")).join(rows, "digest").select("digest", "row_id", "marks")


def _of_two_texts(rows: DataFrame, name: str) -> DataFrame:
    """Values of a column that come with different digests."""
    digest = F.xxhash64("digest")
    return rows.groupBy(name).agg(F.min(digest).alias("low"), F.max(digest).alias("high")).filter("low <> high").select(name)


def _repeats(plain: DataFrame, features: DataFrame, length: int, crowd: int, words: int, spare: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(digest, repeats): for texts with one copy, the ranges of starts whose windows repeat;
    and (digest, passages, spared): the starts, in words, of windows that another text has,
    and those of them that `spare` has as well."""
    classes = features.filter(F.size("starts") > 0).groupBy("digest").agg(
        F.min("doc_id").alias("row_id"),
        *(F.first(c).alias(c) for c in ("starts", "counts", "anchors", "keys", "contents")),
        F.count("*").alias("copies"),
    )
    runs = checkpointed(
        classes.select(
            "digest", "row_id", "copies",
            F.inline(F.arrays_zip(
                F.col("starts").alias("start"), F.col("counts").alias("count"), F.col("anchors").alias("anchor"),
                F.col("keys").alias("key"), F.col("contents").alias("content"),
            )),
        ).toDF("digest", "row_id", "copies", "start", "count", "anchor", "key", "content")
    )
    met = runs.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1").select("key")
    shared = checkpointed(runs.join(met, "key"))
    contents = checkpointed(shared.groupBy("key", "content").agg(
        F.count("*").alias("times"), F.min(F.struct("digest", "row_id", "start", "count", "anchor")).alias("one")
    ))
    whole = shared.filter("copies = 1").join(contents.filter("times > 1").select("key", "content"), ["key", "content"], "left_semi")

    # Edges of passages: several different runs of one anchor.
    various = contents.groupBy("key").agg(F.count("*").alias("kinds"), F.min("times").alias("rarest")).filter("kinds > 1 AND rarest = 1")
    wanted = (
        contents.join(various.select("key", (F.col("kinds") > crowd).alias("crowd")), "key")
        .groupBy("one.digest", "one.row_id")
        .agg(F.collect_list(F.struct("one.start", "one.count", "one.anchor", "key", "content", "crowd")).alias("wanted"))
    )
    if words:  # with the same reading of texts
        wanted = wanted.select("digest", "row_id", "wanted", F.lit(None).cast("array<long>").alias("marks"))
        sharing = _sharing(features).select("digest", "row_id", F.lit(None).cast(wanted.schema["wanted"].dataType).alias("wanted"), "marks")
        wanted = wanted.union(sharing).groupBy("digest").agg(
            F.min("row_id").alias("row_id"), F.first("wanted", ignorenulls=True).alias("wanted"), F.first("marks", ignorenulls=True).alias("marks")
        )
    else:
        wanted = wanted.withColumn("marks", F.lit(None).cast("array<long>"))
    texts = plain.withColumnRenamed("digest", "own").join(
        wanted, (F.col("own") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("row_id"))
    )
    bodies = checkpointed(texts.select("digest", "text", "wanted", "marks").mapInArrow(_bodies(length, words), _BODIES))
    sorted_ = (
        bodies.filter("body IS NOT NULL").select("key", "content", "digest", "start", "count", "left", "body")
        .repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_groups(length), "digest binary, start long, count int")
    )
    counted = bodies.filter("windows IS NOT NULL").dropDuplicates(["key", "content"]).select(
        "digest", F.posexplode("windows").alias("at", "window"), "start"
    )
    often = counted.groupBy("window").agg(F.count("*").alias("times")).filter("times > 1").select("window")
    single = counted.join(often, "window", "left_semi").select("digest", (F.col("start") + F.col("at")).alias("start"), F.lit(1).alias("count"))
    repeats = checkpointed(
        whole.select("digest", "start", "count").union(sorted_).union(single)
        .groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "count"))).alias("repeats"))
    )
    if not words:
        return repeats, None
    windows = bodies.filter("hashes IS NOT NULL").select("digest", "start", F.posexplode("hashes").alias("at", "window"))
    often = _of_two_texts(windows, "window").withColumn("spared", F.lit(False))
    if spare is not None:
        spared = spare.select(F.col(spare.columns[0]).cast("string")).mapInArrow(_spared(words), "window long").distinct()
        often = often.select("window").join(spared.withColumn("found", F.lit(True)), "window", "left").select("window", F.col("found").isNotNull().alias("spared"))
    place = F.col("start") + F.col("at")
    passages = windows.join(often, "window").groupBy("digest").agg(
        F.sort_array(F.collect_set(place)).alias("passages"), F.collect_set(F.when(F.col("spared"), place)).alias("spared")
    )
    return repeats, checkpointed(passages)


def removed_spans(repeats: list, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs [from, to), from sorted ranges of repeated starts."""
    spans: list[list[int]] = []
    for r in repeats:
        start, end = r["start"], r["start"] + r["count"] - 1 + length
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [tuple(s) for s in spans]


def passage_spans(data: bytes, passages: list[int], copied: bool, words: int) -> list[tuple[int, int]]:
    """Byte spans [from, to) of a text's passages, from sorted starts of their windows in words."""
    if not passages and not copied:
        return []
    starts, ends = word_bounds(np.frombuffer(data, np.uint8))
    if copied:
        passages = range(len(starts) - words + 1)
    windows = [{"start": p, "count": 1} for p in passages]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in removed_spans(windows, words)]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return removed_spans([{"start": a, "count": b - a} for a, b in sorted(spans)], 1)


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for s in spans for e in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _cut(length: int, words: int, cut_words: bool, cut_spared: bool, names: list[str], text_col: str, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            texts, kept = batch.column(names.index(text_col)).to_pylist(), []
            stats: list[list] = [[], [], [], [], [], []]
            for text, copied, repeats, sha, passages, spared in zip(texts, *(batch.column(i).to_pylist() for i in range(len(names), len(names) + 5))):
                data = _bytes(text)
                spans = removed_spans(repeats or [], length)
                if copied and len(data) >= length:
                    spans = [(0, len(data))]
                if words:
                    passages, left = passages or [], None
                    if spared:
                        others = passage_spans(data, sorted({*passages} - {*spared}), copied, words)
                    shared = others if spared and not cut_spared else passage_spans(data, passages, copied, words)
                    stats[4].append(sum(b - a for a, b in shared))
                    if cut_words:
                        # Spared words can be part of other passages and go with them.
                        if spared and _joined(spans + others) != _joined(spans + shared):
                            left = _without(data, _joined(spans + others)).decode("utf-8", "ignore")
                        spans = _joined(spans + shared)
                    stats[5].append(left)
                rest = data
                if spans:
                    rest = _without(data, spans)
                    sha = hashlib.sha256(rest).hexdigest()
                stats[0].append(len(data))
                stats[1].append(len(data) - len(rest))
                stats[2].append(len(spans))
                stats[3].append(sha)
                # A cut inside a character leaves bytes that are no text.
                kept.append(rest.decode("utf-8", "ignore") if spans else text)
            columns = [pa.array(kept, pa.string()) if n == text_col else batch.column(i) for i, n in enumerate(names)]
            columns += [pa.array(s, f.type) for s, f in zip(stats, list(schema)[len(names) :])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def remove_repeats(
    docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, columns: list[str] | None = None,
    words: int = 0, cut_words: bool = True, spare: DataFrame | None = None, spared_col: str | None = None,
) -> DataFrame:
    """The documents without the bytes of repeated strings of `length` bytes.

    Returns the input's columns (or those of `columns`; the text always), the
    text without the removed bytes, and n_bytes, n_removed, n_spans,
    kept_sha256 (of the remaining bytes), which replace input columns of these
    names. Texts are UTF-8; where a cut leaves part of a character, the text
    is without it, while kept_sha256 and the counts go by bytes.

    With `words`, passages of so many words that a document with another text
    or a copy has too go as well, the first included, or with `cut_words` off
    are only counted; n_passage_bytes is how many bytes of the text they are.
    `spare` has texts in its first column; windows of words that stand in
    them are no passages. With `spared_col` they are, and go like others; where
    that takes more from a text, this column has the text that is left
    without them being passages, else it is null.

    A null text counts as empty and stays null. Texts shorter than `length`
    are never changed, but by passages. Repeated rows are copies of each other, so they lose
    all bytes. Null ids are ordinary ids. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    bounded_batches(docs.sparkSession)
    stats = {"n_bytes": LongType(), "n_removed": LongType(), "n_spans": LongType(), "kept_sha256": StringType()}
    if words:
        stats["n_passage_bytes"] = LongType()
        if spared_col:
            stats[spared_col] = StringType()
    names = [c for c in (columns or docs.columns) if c not in stats]
    names += [c for c in (id_col, text_col) if c not in names]
    docs = docs.select(*names)
    # The same key for nulls and empty texts, as they are the same bytes.
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("digest", F.unhex(F.md5("text")))
    features = checkpointed(plain.select("doc_id", "text").mapInArrow(_features(length, words), _FEATURES))
    repeats, passages = _repeats(plain, features, length, crowd, words, spare)
    copied = features.groupBy("digest").agg(F.count("*").alias("copies"))
    rows = (
        features.select("doc_id", "digest", "sha").distinct().join(copied, "digest").join(repeats, "digest", "left")
        .join(passages if words else repeats.select("digest", *(F.lit(None).cast("array<long>").alias(c) for c in ("passages", "spared"))), "digest", "left")
        .select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), (F.col("copies") > 1).alias("__copied"), F.col("repeats").alias("__repeats"), F.col("sha").alias("__sha"), F.col("passages").alias("__passages"), F.col("spared").alias("__spared"))
    )
    # Joined by id and text, so that copies spread over all tasks.
    keyed = docs.withColumn("__own", F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    joined = keyed.join(rows, (F.col("__own") == F.col("__digest")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")))
    kept = docs.select(*names)
    schema = StructType([StructField(f.name, StringType() if f.name == text_col else f.dataType) for f in kept.schema])
    for name, kind in stats.items():
        schema = schema.add(name, kind)
    return joined.select(*names, "__copied", "__repeats", "__sha", "__passages", "__spared").mapInArrow(
        _cut(length, words, cut_words, bool(spared_col), names, text_col, to_arrow_schema(schema)), schema
    )
