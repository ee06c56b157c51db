"""Compression of vectors to codes of their parts, by k-means with adaptive bounds.

Every vector is cut into equal parts; each part position has a codebook, and a
part's code is its nearest entry. Codebooks are fitted by rounds of assigning
and averaging, all in integers, so results do not depend on the order in which
rows come.

Distances are saved by adaptive bounds. After the first assignment each part
keeps the `b` entries next to its own, in the order of lower bounds of their
distances, and one outer bound for all other entries. When entries move, a
bound shrinks by what its entry moved, the outer one by the longest move. The
distance to the own entry is computed exactly; entries whose bound it stays
below cannot be nearer. The others, a beginning of the ordered list, are
verified by integer distances, ties to the lower index; a part whose outer
bound is reached too is compared with all entries. `b` begins at a quarter of
the entries and follows the deepest place that a search needed, down to an
eighth.

The state of all parts is a table that each round reads and writes anew; what
comes to the driver are sums per part, entry and component.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed, release

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Largest magnitude of a component; squared distances then fit into 64 bits.
LARGEST = 1 << 16
#: Ways in which rows of one label are split when its error is joined to them.
SALTS = 16

_STATE_NAMES = ["vec_id", "label", "v", "code", "near", "low", "outer", "depth"]


def _down(x: np.ndarray) -> np.ndarray:
    """Not above x, in 32 bits."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to all entries, exactly."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    # Matrix products of doubles are exact below 2**53.
    if 4 * x.shape[1] * largest**2 < 1 << 53:
        one, two = x.astype(float), book.astype(float)
        return ((one**2).sum(1)[:, None] - 2 * one @ two.T + (two**2).sum(1)).astype(np.int64)
    return np.stack([((x - entry) ** 2).sum(1) for entry in book], axis=1)


@dataclass
class Bounds:
    """One part of many vectors: own entry, the next ones with ordered lower bounds, and one bound for the rest."""

    code: np.ndarray
    near: np.ndarray
    low: np.ndarray
    outer: np.ndarray


def searched(x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
    """Bounds by comparison with all entries."""
    exact = squared(x, book)
    # A stable order takes the lower index first.
    order = np.argsort(exact, axis=1, kind="stable")[:, : b + 2]
    root = _down(np.sqrt(np.take_along_axis(exact, order, 1)))
    outer = root[:, b + 1] if order.shape[1] > b + 1 else np.full(len(x), np.inf, np.float32)
    return Bounds(order[:, 0].astype(np.uint8), order[:, 1 : b + 1].astype(np.uint8), root[:, 1 : b + 1], outer)


def moved(x: np.ndarray, book: np.ndarray, moves: np.ndarray, old: Bounds, b: int) -> tuple[Bounds, int]:
    """Bounds of at most `b` entries after the entries moved, and the deepest
    place of the ordered bounds that a search reached."""
    code = old.code.astype(np.int64)
    own = ((x - book[code]) ** 2).sum(1)
    reach = _up(np.sqrt(own))
    low = _down(old.low - moves[old.near])
    outer = _down(old.outer - moves.max())
    order = np.argsort(low, axis=1, kind="stable")
    low, near = np.take_along_axis(low, order, 1), np.take_along_axis(old.near, order, 1).astype(np.int64)
    if b < near.shape[1]:
        outer = np.minimum(outer, low[:, b])
        low, near = low[:, :b], near[:, :b]
    depth = (low <= reach[:, None]).sum(1)
    whole = outer <= reach
    some = np.flatnonzero(~whole & (depth > 0))
    deepest = int(depth[some].max(initial=0))
    if len(some):
        asked = np.arange(deepest) < depth[some][:, None]
        front = near[some, :deepest]
        exact = ((x[some][:, None, :] - book[front]) ** 2).sum(2)
        low[some, :deepest] = np.where(asked, _down(np.sqrt(exact)), low[some, :deepest])
        # The nearest of those asked, the lower index among equals.
        best = np.full(len(some), np.iinfo(np.int64).max)
        best = np.where(asked, exact, best[:, None]).min(1)
        entry = np.where(asked & (exact == best[:, None]), front, len(book)).min(1)
        wins = (best < own[some]) | ((best == own[some]) & (entry < code[some]))
        row, entry = some[wins], entry[wins]
        at = (near[row] == entry[:, None]).argmax(1)
        near[row, at], low[row, at] = code[row], _down(np.sqrt(own[row]))
        code[row] = entry
        order = np.argsort(low[some], axis=1, kind="stable")
        low[some], near[some] = np.take_along_axis(low[some], order, 1), np.take_along_axis(near[some], order, 1)
    new = Bounds(code.astype(np.uint8), near.astype(np.uint8), low, outer)
    if whole.any():
        again = searched(x[whole], book, near.shape[1])
        new.code[whole], new.near[whole], new.low[whole], new.outer[whole] = again.code, again.near, again.low, again.outer
    return new, deepest


def _integers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1)


def _cells(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    if 0 in shape:
        return np.zeros((len(column), *shape), kind)
    return np.stack([np.frombuffer(c, kind) for c in column.to_pylist()]).reshape(len(column), *shape)


def _binary(cells: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in cells], pa.binary())


def _state(head: list[pa.Array], v: np.ndarray, found: list[Bounds], depth: int) -> pa.RecordBatch:
    columns = [np.stack([getattr(f, name) for f in found], axis=1) for name in ("code", "near", "low", "outer")]
    depths = pa.array(np.full(len(v), depth), pa.int32())
    return pa.RecordBatch.from_arrays([*head, _binary(v.astype("<i4")), *map(_binary, columns), depths], names=_STATE_NAMES)


def _first(books: np.ndarray, b: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _integers(batch.column(2))
                parts = v.reshape(len(v), len(books), -1)
                yield _state(batch.columns[:2], v, [searched(parts[:, p], books[p], b) for p in range(len(books))], 0)

    return run


def _next(books: np.ndarray, moves: np.ndarray, had: int, b: int, last: bool):
    many = len(books)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _cells(batch.column(2), "<i4", many, books.shape[2]).astype(np.int64)
            code, near = _cells(batch.column(3), "u1", many), _cells(batch.column(4), "u1", many, had)
            low, outer = _cells(batch.column(5), "<f4", many, had), _cells(batch.column(6), "<f4", many)
            olds = (Bounds(code[:, p], near[:, p], low[:, p], outer[:, p]) for p in range(many))
            found, depths = zip(*(moved(v[:, p], books[p], moves[p], old, b) for p, old in enumerate(olds)))
            if not last:
                yield _state(batch.columns[:2], v.reshape(len(v), -1), found, max(depths))
                continue
            codes = np.stack([f.code for f in found], axis=1)
            error = sum(((v[:, p] - books[p][codes[:, p]]) ** 2).sum(1) for p in range(many))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def _sums(parts: int, entries: int, width: int):
    """Sums and counts of a task's vectors by part and entry as (cell, value), and
    the deepest search as cell -1."""

    def run(batches):
        total, deepest = np.zeros((parts, entries, width + 1), np.int64), 0
        for batch in batches:
            if batch.num_rows:
                v, code = _cells(batch.column(0), "<i4", parts, width), _cells(batch.column(1), "u1", parts)
                deepest = max(deepest, pc.max(batch.column(2)).as_py())
                for p in range(parts):
                    np.add.at(total[p], code[:, p], np.pad(v[:, p].astype(np.int64), ((0, 0), (0, 1)), constant_values=1))
        used = np.flatnonzero(total.ravel())
        cells, values = np.append(used, -1), np.append(total.ravel()[used], deepest)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(values, pa.int64())], names=["cell", "value"])

    return run


def _averaged(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, int]:
    """Entries replaced by the floored means of their parts, unused ones as they
    were; and the deepest search."""
    parts, entries, width = books.shape
    sums = state.select("v", "code", "depth").mapInArrow(_sums(parts, entries, width), "cell long, value long")
    total, deepest = np.zeros(parts * entries * (width + 1), np.int64), 0
    for row in sums.groupBy("cell").agg(F.sum("value").alias("value"), F.max("value").alias("top")).collect():  # one row a cell at most
        if row.cell < 0:
            deepest = row.top
        else:
            total[row.cell] = row.value
    total = total.reshape(parts, entries, width + 1)
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books), deepest


def _start(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Integer components of the vectors with the smallest ids, one row each."""
    smallest = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries)
    found = [r.vector for r in smallest.collect()]
    if len({len(v) for v in found}) > 1:  # the first one's length decides
        found = [r.vector for r in smallest_of_length(kept, len(found[0]), entries).collect()]
    return np.floor(SCALE * np.array(found, float)).astype(np.int64).reshape(len(found), len(found[0]) if found else 0)


def smallest_of_length(kept: DataFrame, length: int, entries: int) -> DataFrame:
    return kept.filter(F.size("vector") == length).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries)


def codebooks_digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal integers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (part, entry, component).

    The frame has vec_id, label, code (two hex digits for each part) and error
    (squared distances to the entries, summed over the parts), and is a table
    in the checkpoint folder. Components are floor(256 x).

    Dropped are null vectors, vectors with null or non-finite components or
    with one beyond `LARGEST`, and vectors whose length is no multiple of
    `parts` or not that of the kept vector with the smallest id. Codebooks
    start with the vectors of the smallest ids, equal ids by components, null
    ids last; with fewer vectors there are fewer entries. Repeated rows and
    rows of null or repeated ids stay. Other columns are not read. An empty
    table gives no rows and codebooks without entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have one byte for each part")
    whole = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) <= LARGEST, F.lit(False)) & ~F.isnan(x.cast("double")))
    kept = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    ).filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0) & whole)
    kind = kept.schema["label"].dataType.simpleString()
    start = _start(kept, parts, entries)
    if not len(start):
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = np.stack(np.split(start, parts, axis=1))
    b = min(max(1, entries // 4), len(start) - 1)
    schema = f"vec_id long, label {kind}, v binary, code binary, near binary, low binary, outer binary, depth int"
    state = checkpointed(kept.filter(F.size("vector") == start.shape[1]).select("vec_id", "label", "vector").mapInArrow(_first(books, b), schema))
    had = b
    for number in range(rounds):
        new, deepest = _averaged(state, books)
        moves = _up(np.sqrt(((new - books) ** 2).sum(2).astype(float)))
        if number:  # the first assignment searched without bounds
            b = min(b, max(entries // 8, deepest))
        books, last = new, number == rounds - 1
        following = state.mapInArrow(_next(books, moves, had, b, last), f"vec_id long, label {kind}, code string, error long" if last else schema)
        done = checkpointed(following)
        release(state)
        state, had = done, b
    return state, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with label_error: error summed over equal labels, nulls together.

    Sums are joined in `SALTS` copies, so rows of one label are dealt over as many tasks.
    """
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    copies = totals.withColumnRenamed("label", "of_label").withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    met = salted.join(copies, salted["label"].eqNullSafe(copies["of_label"]) & (F.col("salt") == F.col("of_salt")))
    return met.drop("salt", "of_label", "of_salt")
