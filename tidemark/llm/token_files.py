"""Token ids of documents in compressed files with access to single documents.

A folder holds three Parquet tables:

* `dictionary`: one row, the shared zstandard dictionary, its sha256, the byte
  width of an id and the end id;
* `blocks`: documents in ascending order of their ids, many to a row. The
  payload is one zstandard frame per document, each compressed by itself
  against the dictionary, over the ids as little-endian integers. Beside it
  stand the dictionary's hash, the documents' ids and id counts, and the
  offset index: frame i is payload[offsets[i] : offsets[i + 1]];
* `shards`: for each shard the number of ids before it and in it. A shard is
  what one task wrote, a range of document ids.

To fetch a document its block's index columns and one slice of a payload are
needed. Spark writes the tables, so files appear whole or not at all, and a
lost executor costs the ranges it was writing.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe_automaton import _Store
from tidemark.llm.common import bounded_batches
from tidemark.session import ensure_checkpoint_dir

#: Bounds of the sample that the dictionary is trained on: documents about, and the bytes
#: of each, which of a longer one are that many pieces spread over the whole of it.
SAMPLE_DOCUMENTS = 1000
SAMPLE_BYTES = 16 << 10
SAMPLE_PIECES = 8
DICTIONARY_BYTES = 64 << 10
#: A block is closed at this payload or number of documents.
BLOCK_BYTES = 1 << 20
BLOCK_DOCUMENTS = 1024
#: Texts that are encoded together, by their bytes, and words that are looked up together.
_TEXT_BYTES = 4 << 20
_WORDS_AT_ONCE = 1 << 20
#: Words that a worker remembers, and their longest.
_KNOWN = 400_000
_LONGEST = 40
#: Punctuation at a word's end, after a letter or digit: always a token run of its own.
#: (A dotted capital I ends in a mark, which joins the run, when lower-cased.)
_TAIL = ".,;:!?%$*&#\"()/+=[]{}-"
#: Stands between words that are encoded together.
_MARK = "~"
#: Normalizer steps and splitting of tokenizers whose words do not depend on each other. Fixed values.
_BY_WORDS = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Encoder:
    """A tokenizer that remembers the ids of words.

    For tokenizers that drop white space and lower-case (`by_words`, told by
    the file's own rules), a blank or line feed always ends a token and what
    stands beside it has no influence, so words are encoded one by one by the
    library and joined. Any other white space stays inside a word and is the
    library's to treat. It takes runs of punctuation apart from letters and
    digits, so ASCII case and punctuation at a word's end are told apart here
    already. With any other tokenizer the library gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self.by_words = _splits_words(path)
        # ASCII lower-case words are what normalizing and splitting leave whole, so blanks alone divide them.
        self._letters = Tokenizer.from_file(path)
        self._letters.no_truncation()
        self._letters.no_padding()
        self._letters.normalizer = normalizers.Sequence([])
        self._letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        mark = self._tokenizer.encode(f" {_MARK} ", add_special_tokens=False).ids
        self._mark = mark[0] if len(mark) == 1 else -1
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._forget()

    def _forget(self) -> None:
        self._words, self._parts = _Store(), _Store()
        self._parts.add([""], np.empty(0, np.uint32), np.zeros(1, np.int64))

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _encoded(self, words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without the mark, and their counts; encoded as one text,
        with the mark, a single token, between them."""
        joined = tokenizer.encode_batch_fast([f" {_MARK} ".join([*words, ""])], add_special_tokens=False)[0]
        ids = np.array(joined.ids, np.uint32)
        marks = ids == self._mark
        ends = np.flatnonzero(marks)
        if len(ends) != len(words):
            return self._alone(words)
        return ids[~marks], np.diff(ends, prepend=-1) - 1

    def _learn(self, words: list[str]) -> None:
        """Words in other case or before a punctuation mark share their parts."""
        parts = []
        for word in words:
            core = word.rstrip(_TAIL)
            if len(core) == len(word) or not core or not core[-1].isalnum() or core[-1] == "İ" or "<|" in word:
                core, tail = word, ""
            else:
                tail = word[len(core) :]
            parts += (core.lower() if core.isascii() and "<|" not in core else core), tail
        new = list(set(parts).difference(self._parts.number))
        marked = [p for p in new if _MARK in p]
        letters = [p for p in new if p.isascii() and p.isalpha()]
        rest = set(new).difference(letters, marked)
        for plain, tokenizer in ((letters, self._letters), (list(rest), self._tokenizer)):
            for at in range(0, len(plain), 2000):
                self._parts.add(plain[at : at + 2000], *self._encoded(plain[at : at + 2000], tokenizer))
        if marked:
            self._parts.add(marked, *self._alone(marked))
        flat, sizes = self._parts.of(np.fromiter(map(self._parts.number.__getitem__, parts), np.int64, len(parts)))
        self._words.add(words, flat, sizes.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every whole text; null is empty."""
        texts = texts.fill_null("")
        if not len(texts):
            return []
        if not self.by_words:
            return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        # Python only sees the different words.
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words, sizes, out = split.flatten(), [np.zeros(1, np.int64)], [np.empty(0, np.uint32)]
        for at in range(0, len(words), _WORDS_AT_ONCE):
            if max(len(self._words.number), len(self._parts.number)) > _KNOWN:
                self._forget()
            part = words.slice(at, _WORDS_AT_ONCE).dictionary_encode()
            own, known = part.dictionary.to_pylist(), self._words.number
            new = [w for w in own if w not in known]
            if new:
                self._learn(new)
            numbers = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
            ids, size = self._words.of(numbers[part.indices.to_numpy(zero_copy_only=False)])
            out.append(ids.view(np.uint32))
            sizes.append(size)
            for word in new:
                if len(word) > _LONGEST:  # comes once; its number stays taken
                    known[f"\n{known.pop(word)}"] = -1
        ends = np.cumsum(np.concatenate(sizes))[np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))]
        return np.split(np.concatenate(out), ends[:-1])


def _splits_words(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    steps = (rules["normalizer"] or {}).get("normalizers", [])
    splitting = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    first = splitting[0] if splitting else {}
    added = rules["added_tokens"]
    return (
        [n["type"] for n in steps] == _BY_WORDS[0]
        and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
        and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": _BY_WORDS[1]}, "Removed", True)
        and not rules["model"].get("dropout")
        and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in added)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
    )


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _frames(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def _pieces(data: bytes) -> bytes:
    """The data, or of longer ones SAMPLE_PIECES pieces from its beginning to its end."""
    if len(data) <= SAMPLE_BYTES:
        return data
    size = SAMPLE_BYTES // SAMPLE_PIECES
    starts = [(len(data) - size) * i // (SAMPLE_PIECES - 1) // 4 * 4 for i in range(SAMPLE_PIECES)]
    return b"".join(data[s : s + size] for s in starts)


def _portions(texts: pa.Array):
    """Bounds of runs of texts of about _TEXT_BYTES, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    groups = (np.cumsum(sizes, dtype=np.int64) - sizes) // _TEXT_BYTES
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]
    return zip(edges, edges[1:])


def _sample(path: str, end_id: int):
    def run(batches):
        tokenizer = encoder(path)
        for batch in batches:
            for a, b in _portions(batch.column(0)):
                found = tokenizer.encode(batch.column(0).slice(a, b - a))
                rows = [_pieces(_frames(np.append(ids, end_id), tokenizer.width)) for ids in found]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    return run


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int) -> bytes:
    """Dictionary over the serialized ids of about SAMPLE_DOCUMENTS documents,
    chosen by a hash of id and text; empty where there is nothing to learn."""
    rows = docs.count()
    if not rows:
        return b""
    share = max(1, rows // SAMPLE_DOCUMENTS)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(share)) == 0).select("text").limit(2 * SAMPLE_DOCUMENTS)
    samples = [bytes(r.ids) for r in some.mapInArrow(_sample(tokenizer_path, end_id), "ids binary").collect()]
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on: the samples themselves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


_BLOCKS = (
    "shard int, block int, start long, n_tokens long, dictionary_sha256 string, "
    "doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"
)


def _write(tokenizer_path: str, end_id: int, dictionary: bytes):
    sha = hashlib.sha256(dictionary).hexdigest()

    def run(batches):
        tokenizer = encoder(tokenizer_path)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
        shard, block, start, size = TaskContext.get().partitionId(), 0, 0, 0
        ids, counts, frames = [], [], []

        def closed():
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            row = {
                "shard": shard, "block": block, "start": start, "n_tokens": sum(counts), "dictionary_sha256": sha,
                "doc_ids": ids, "counts": counts, "offsets": offsets, "payload": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=_schema)

        def encoded(batch):
            for a, b in _portions(batch.column(1)):
                part = batch.slice(a, b - a)
                found = tokenizer.encode(part.column(1))
                for doc_id, tokens in zip(part.column(0).to_pylist(), found):
                    yield doc_id, np.append(tokens, end_id)

        for batch in batches:
            for doc_id, tokens in encoded(batch):
                frame = compressor.compress(_frames(tokens, tokenizer.width))
                ids.append(doc_id)
                counts.append(len(tokens))
                frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCUMENTS:
                    yield closed()
                    block, start, size = block + 1, start + sum(counts), 0
                    ids, counts, frames = [], [], []
        if ids:
            yield closed()

    return run


_schema = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("dictionary_sha256", pa.string()),
    ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every whole text, append the end id, and write the three tables to `path`.

    Null and empty texts are the end id alone. Documents with a null id come
    first; rows with equal ids are ordered by a hash of the text, which also
    spreads the rows of one id, and equal rows are kept as often as they come. Other columns are not read. An empty
    table gives a dictionary of no bytes and no blocks.
    """
    spark = bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(plain, tokenizer_path, end_id)
    width = encoder(tokenizer_path).width
    spark.createDataFrame(
        [(hashlib.sha256(dictionary).hexdigest(), dictionary, width, end_id)], "sha256 string, data binary, width int, end_id long"
    ).coalesce(1).write.parquet(f"{path}/dictionary")
    ordered = plain.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )
    ordered.mapInArrow(_write(tokenizer_path, end_id, dictionary), _BLOCKS).write.parquet(f"{path}/blocks")
    # One row for each task that wrote, so the running sum is over few rows.
    sums = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/shards")


def _read(dictionary: bytes, sha: str, width: int, with_ids: bool):
    def run(batches):
        decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError("a block was written with another dictionary")
                at, out = row["base"] + row["start"], {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                for i, doc_id in enumerate(row["doc_ids"]):
                    frame = row["payload"][row["offsets"][i] : row["offsets"][i + 1]]
                    ids = np.frombuffer(decompressor.decompress(frame), f"<u{width}").astype("<u4")
                    out["doc_id"].append(doc_id)
                    out["start"].append(at)
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids))
                    if with_ids:
                        out["ids"].append(ids)
                    at += len(ids)
                if not with_ids:
                    del out["ids"]
                kinds = {"ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of a folder: doc_id, start (ids of all documents before), n_tokens,
    ids_crc32 and, if asked for, the ids.

    With `doc_ids`, only blocks whose index names one of them are opened, and
    only those documents' frames are decompressed.
    """
    # A block is about a megabyte, so a few make a batch.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    head = spark.read.parquet(f"{path}/dictionary").first()
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/shards").select("shard", "base"), "shard")
    if doc_ids is not None:
        asked = F.array(*[F.lit(i).cast("long") for i in doc_ids])
        found = F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.array_contains(asked, F.element_at("doc_ids", i)))
        blocks = blocks.filter(F.arrays_overlap("doc_ids", asked)).withColumn("i", F.explode(found)).select(
            "shard", "base", "dictionary_sha256",
            (F.col("start") + F.aggregate(F.slice("counts", 1, F.col("i") - 1), F.lit(0).cast("long"), lambda a, c: a + c)).alias("start"),
            F.array(F.element_at("doc_ids", F.col("i"))).alias("doc_ids"),
            F.array(F.lit(0).cast("long"), F.element_at("offsets", F.col("i") + 1) - F.element_at("offsets", F.col("i"))).alias("offsets"),
            F.expr("substring(payload, cast(element_at(offsets, i) + 1 as int), cast(element_at(offsets, i + 1) - element_at(offsets, i) as int))").alias("payload"),
        )
    rows = blocks.select("base", "start", "dictionary_sha256", "doc_ids", "offsets", "payload")
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_read(bytes(head.data), head.sha256, head.width, with_ids), kind)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
