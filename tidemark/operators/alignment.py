"""Lines of two versions of a text, side by side and in order."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# Cells of a table of common subsequences; longer gaps are halved first.
TABLE_CELLS = 1 << 20
# Rows that a task hands back at once.
ROWS_AT_ONCE = 50_000

_BLANK = " \t\n\x0b\f\r"


def _compared(line: str) -> str:
    """A line as it is compared: trimmed, no trailing commas."""
    return line.strip(_BLANK).rstrip(",")


def _rising(ends: list[int]) -> list[int]:
    """Positions of a longest rising subsequence of distinct numbers."""
    tails, at, before = [], [], [-1] * len(ends)
    for i, end in enumerate(ends):
        k = bisect_left(tails, end)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(end)
            at.append(i)
        else:
            tails[k], at[k] = end, i
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of x and every beginning of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
    return row


def _common(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of a longest common subsequence, in memory linear in the lines."""
    if not len(x) or not len(y):
        return
    if len(x) == 1:
        hits = np.flatnonzero(y == x[0])
        if len(hits):
            yield 0, int(hits[0])
    elif len(x) * len(y) <= TABLE_CELLS:
        table = [np.zeros(len(y) + 1, np.int32)]
        for v in x:
            row = table[-1].copy()
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
            table.append(row)
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        yield from reversed(pairs)
    else:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        yield from _common(x[:half], y[:cut])
        yield from ((i + half, j + cut) for i, j in _common(x[half:], y[cut:]))


def _gap(x: np.ndarray, y: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> Iterator[tuple[int, int]]:
    """Pairs of equal lines between two pairs already made."""
    while i0 < i1 and j0 < j1 and x[i0] == y[j0]:
        yield i0, j0
        i0, j0 = i0 + 1, j0 + 1
    tail = []
    while i0 < i1 and j0 < j1 and x[i1 - 1] == y[j1 - 1]:
        i1, j1 = i1 - 1, j1 - 1
        tail.append((i1, j1))
    # A line that one side lacks can be in no pair.
    xs = i0 + np.flatnonzero(np.isin(x[i0:i1], y[j0:j1]))
    ys = j0 + np.flatnonzero(np.isin(y[j0:j1], x[i0:i1]))
    yield from ((int(xs[i]), int(ys[j])) for i, j in _common(x[xs], y[ys]))
    yield from reversed(tail)


def _equal_pairs(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of equal lines, rising on both sides. Lines that occur once on
    each side are matched first, the longest rising run of them; between
    those a longest common subsequence is taken."""
    xs, ys = Counter(x.tolist()), Counter(y.tolist())
    once = {v: j for j, v in enumerate(y.tolist()) if ys[v] == 1 and xs.get(v) == 1}
    met = [(i, once[v]) for i, v in enumerate(x.tolist()) if v in once]
    i0 = j0 = 0
    for i, j in [*(met[k] for k in _rising([j for _, j in met])), (len(x), len(y))]:
        yield from _gap(x, y, i0, i, j0, j)
        if i < len(x):
            yield i, j
        i0, j0 = i + 1, j + 1


def _first_word(line: str) -> str:
    return line.replace("(", " ").split(" ", 1)[0]


def aligned(source: str | None, target: str | None) -> Iterator[tuple[int | None, int | None, str]]:
    """(source line, target line, kind), numbered from 1, in order."""
    new, old = ([_compared(t) for t in text.split("\n")] if text is not None else [] for text in (source, target))
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(v, len(numbers)) for v in lines], np.int64) for lines in (new, old))
    i0 = j0 = 0
    for i, j in [*_equal_pairs(x, y), (len(new), len(old))]:
        places = defaultdict(list)
        for k in range(j0, j):
            if word := _first_word(old[k]):
                places[word].append(k)
        for here in range(i0, i):
            found = places.get(_first_word(new[here]), [])
            k = bisect_left(found, j0)
            if k < len(found):
                yield from ((None, gone + 1, "removed") for gone in range(j0, found[k]))
                yield here + 1, found[k] + 1, "changed"
                j0 = found[k] + 1
            else:
                yield here + 1, None, "added"
        yield from ((None, gone + 1, "removed") for gone in range(j0, j))
        if i < len(new):
            yield i + 1, j + 1, "same"
        i0, j0 = i + 1, j + 1


def line_alignment(src: DataFrame, tgt: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, source_line, target_line, kind) of two versions of many texts.

    kind is same, changed, added (source only) or removed (target only); every
    line is there once, and lines of a kind with both numbers rise on both
    sides, so a line that has moved is added in one place and removed in the
    other. Lines are compared trimmed and without trailing commas. Between
    equal lines, those that begin with the same word are paired as changed.

    Documents must be unique on each side; one that a side lacks, or whose
    text is null there, has no lines on it. Both versions of a text meet in
    one row, and each is aligned by itself, in memory linear in its lines.
    """
    side = lambda df, name: df.select(F.col(doc).alias("doc"), F.col(text).alias(name))
    both = side(src, "source").join(side(tgt, "target"), "doc", "full_outer")
    schema = T.StructType(
        [
            T.StructField("doc", both.schema["doc"].dataType), T.StructField("source_line", T.IntegerType()),
            T.StructField("target_line", T.IntegerType()), T.StructField("kind", T.StringType()),
        ]
    )

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows):
            out = pd.DataFrame(rows, columns=["doc", "source_line", "target_line", "kind"])
            return out.astype({"source_line": "Int32", "target_line": "Int32"})

        rows = []
        for batch in batches:
            for name, new, old in zip(batch["doc"], batch["source"], batch["target"]):
                for line in aligned(new, old):
                    rows.append((name, *line))
                    if len(rows) == ROWS_AT_ONCE:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    return both.mapInPandas(align, schema).withColumnRenamed("doc", doc)
