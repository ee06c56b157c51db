"""Fill-in-the-middle forms of documents, put together by secondary sort.

A text is cut at two places into prefix, middle and suffix, and written as

* plain: the text itself;
* psm: `<P>` prefix `<S>` suffix `<M>` middle;
* spm: `<S>` suffix `<P>` prefix `<M>` middle.

Nothing is put together in one piece. A map step emits chunks of at most
`CHUNK` units (code points) keyed by document and output position;
`repartitionAndSortWithinPartitions` brings the pieces of a document to one
task in output order, where they stream into an incremental digest or a text.
Restoring reads such a stream, finds the marks in it and emits its pieces
keyed by document and place in the text. The partitioner stays the same, so
sorting again moves nothing between tasks.

A task sorts with bounded memory (`spark.python.worker.memory`) and spills
beyond it. The key holds the row's place in its input partition, so rows of a
null or repeated id spread like all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

from pyspark import TaskContext
from pyspark.rdd import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of a piece, and text bytes of a partition.
CHUNK = 1 << 14
PARTITION_BYTES = 32 << 20
#: Parts of 100 that stay plain, and of the others those that become spm.
PLAIN_FROM, SPM_BELOW = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Parts in the order in which each form has them.
_PARTS = {"plain": ("text",), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Parts in the order of the text.
_PLACE = {"text": 0, PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

#: A document's place: input partition and number in it.
Row = tuple[int, int]
Piece = tuple[tuple[Row, int], object]


def numbers(doc_id: int | None, seed: str = "1") -> list[int]:
    """h1 to h4 of a document; a null id has no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def plan(doc_id: int | None, text: str) -> tuple[str, int, int]:
    """Form of a document and the ends of its prefix and middle."""
    n = len(text)
    h1, h2, h3, h4 = numbers(doc_id)
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return "plain", 0, 0
    return "spm" if h4 % 100 < SPM_BELOW else "psm", one, two


def _cut(text: str, begin: int, end: int) -> Iterator[str]:
    return (text[at : min(at + CHUNK, end)] for at in range(begin, end, CHUNK))


def _emitted(rows: Iterable[tuple]) -> Iterator[Piece]:
    """A head before each document's pieces, then the pieces by output position."""
    part = TaskContext.get().partitionId()
    for number, (doc_id, text) in enumerate(rows):
        text, row = text or "", (part, number)
        form, one, two = plan(doc_id, text)
        bounds = {"text": (0, len(text)), PREFIX: (0, one), MIDDLE: (one, two), SUFFIX: (two, len(text))}
        plain = form == "plain"
        yield (row, -1), (doc_id, len(text), form, None if plain else one, None if plain else two - one)
        position = 0
        for kind in _PARTS[form]:
            for piece in ([] if plain else [kind]), _cut(text, *bounds[kind]):
                for chunk in piece:
                    yield (row, position), chunk
                    position += len(chunk)


def _spread(row: tuple[Row, int]) -> int:
    """Partitioner: by row, whatever the position."""
    (part, number), _ = row
    return (part * 0x9E3779B1 + number * 0x85EBCA77) >> 7


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> RDD:
    """Pieces ((row, position), chunk) in output order within their documents,
    each document whole in one partition, its head (row, -1) first.

    Unless `partitions` is given, one is made for every PARTITION_BYTES of text,
    so tasks stay of a size as the input grows. The input must give the same
    rows in the same partitions if a task is repeated, as stored tables do.
    """
    plain = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").alias("text"))
    many = partitions or _partitions(plain)
    return plain.rdd.mapPartitions(_emitted).repartitionAndSortWithinPartitions(many, _spread)


def _partitions(texts: DataFrame) -> int:
    """Partitions for the bytes of all texts, no fewer than Spark runs at once."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(-(-total // PARTITION_BYTES), texts.sparkSession.sparkContext.defaultParallelism)


def _documents(sorted_pieces: Iterable[Piece]) -> Iterator[tuple[Row, tuple, Iterator[str]]]:
    """Row, head and stream of chunks of one document after the other."""
    stream = iter(sorted_pieces)
    ahead = next(stream, None)

    def chunks(row: Row) -> Iterator[str]:
        nonlocal ahead
        while ahead is not None and ahead[0][0] == row:
            yield ahead[1]
            ahead = next(stream, None)

    while ahead is not None:
        (row, _), head = ahead
        ahead = next(stream, None)
        own = chunks(row)
        yield row, head, own
        for _ in own:  # what the reader left
            pass


def parts_of(form: str, chunks: Iterable[str]) -> Iterator[tuple[int, str]]:
    """(place of the part, chunk) of an output stream, marks found and left out,
    also where a mark lies across two chunks."""
    if form == "plain":
        yield from ((0, c) for c in chunks)
        return
    marks, held, part = list(_PARTS[form]), "", None
    for chunk in chunks:
        held += chunk
        while marks and (at := held.find(marks[0])) >= 0:
            if at:
                yield part, held[:at]
            part, held = _PLACE[marks[0]], held[at + len(marks.pop(0)) :]
        # A mark may have begun at the end of what is held.
        sure = len(held) - (len(PREFIX) - 1 if marks else 0)
        if sure > 0:
            yield part, held[:sure]
            held = held[sure:]
    if held:
        yield part, held


def _restoring(make: Callable, add: Callable, get: Callable):
    """Streams of output pieces to pieces in the order of the text; what is made
    of the output by `make`, `add` and `get` goes into the head."""

    def run(sorted_pieces: Iterable[Piece]) -> Iterator[Piece]:
        for row, head, chunks in _documents(sorted_pieces):
            state = make()

            def seen():
                nonlocal state
                for chunk in chunks:
                    state = add(state, chunk)
                    yield chunk

            for number, (place, chunk) in enumerate(parts_of(head[2], seen())):
                yield (row, (place << 40) + number), chunk
            yield (row, -1), (*head, get(state))

    return run


def _finished(make: Callable, add: Callable, get: Callable):
    def run(sorted_pieces: Iterable[Piece]) -> Iterator[tuple]:
        for _, head, chunks in _documents(sorted_pieces):
            state = make()
            for chunk in chunks:
                state = add(state, chunk)
            yield *head, get(state)

    return run


def _hashed(state, chunk: str):
    state.update(chunk.encode("utf-8", "surrogatepass"))
    return state


def _kept(state: list[str], chunk: str) -> list[str]:
    state.append(chunk)
    return state


_DIGEST = (hashlib.sha256, _hashed, lambda s: s.hexdigest())
_TEXT = (list, _kept, "".join)
_HEAD = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def _restored(docs: DataFrame, fold: tuple, columns: str, id_col: str, text_col: str, partitions: int | None) -> DataFrame:
    outputs = pieces(docs, id_col, text_col, partitions)
    again = outputs.mapPartitions(_restoring(*fold), preservesPartitioning=True)
    # The same partitions and partitioner: sorted again where the pieces are.
    places = again.repartitionAndSortWithinPartitions(outputs.getNumPartitions(), _spread)
    return docs.sparkSession.createDataFrame(places.mapPartitions(_finished(*fold)), f"{_HEAD}, {columns}", verifySchema=False)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Documents in their forms: doc_id, n (code points), form, prefix_chars and
    middle_chars (null if plain), output.

    Null texts are empty and plain. A null id draws its form as an id without
    digits. Rows stay as many as they are, repeated ones too; other columns
    are not read. An empty table gives an empty result.
    """
    made = pieces(docs, id_col, text_col, partitions).mapPartitions(_finished(*_TEXT))
    return docs.sparkSession.createDataFrame(made, f"{_HEAD}, output string", verifySchema=False)


def restore(outputs: DataFrame, id_col: str = "doc_id", form_col: str = "form", output_col: str = "output") -> DataFrame:
    """Texts from outputs and forms alone: doc_id, text. Null outputs are empty;
    a null form is plain."""
    rows = outputs.select(F.col(id_col).cast("long"), F.col(form_col), F.col(output_col).alias("text"))

    def emitted(part: Iterable[tuple]) -> Iterator[Piece]:
        own = TaskContext.get().partitionId()
        for number, (doc_id, form, output) in enumerate(part):
            output, row = output or "", (own, number)
            yield (row, -1), (doc_id,)
            for i, (place, chunk) in enumerate(parts_of(form or "plain", _cut(output, 0, len(output)))):
                yield (row, (place << 40) + i), chunk

    placed = rows.rdd.mapPartitions(emitted).repartitionAndSortWithinPartitions(_partitions(rows), _spread)
    made = placed.mapPartitions(_finished(*_TEXT))
    return outputs.sparkSession.createDataFrame(made, "doc_id long, text string", verifySchema=False)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """As `transform`, with the sha256 of the output and that of the text restored
    from it instead of the output; no text is ever held whole after the cut."""
    return _restored(docs, _DIGEST, "output_sha256 string, restored_sha256 string", id_col, text_col, partitions)
