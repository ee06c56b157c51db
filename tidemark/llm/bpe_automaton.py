"""Byte-pair encoding and decoding by a tokenization automaton.

A merge list is compiled into a deterministic automaton over tokens that
accepts exactly the token sequences the list produces. It begins as one state
with a loop for every byte. The gadget of a merge (u, v) -> uv is put in for
one merge after the other:

* the state after uv is a copy of the state after v as it is now;
* the state after u loses its arc v, as the pair would have been merged;
* every state with an arc u gets an arc uv, the others do not.

States are therefore told apart by their last token. By the third rule an arc
that is lost stays lost for all labels later built on it from the left, so
labels are numbered in preorder of the tree "uv is a child of u", children by
age: what one gadget takes from a state is a label and one range of labels.
The compiled table holds the closed ranges of every state, and an arc exists
where its number lies in none.

A word is spelled by exactly one accepted sequence, and so is each of its
beginnings. Encoding walks a word once: from each place, labels that go on
are read from a trie, and an arc from the place's state leads to the state of
the place where the label ends. Decoding emits the labels of the arcs taken.

All tables depend on the vocabulary alone. Words are looked up in a bounded
memory before they walk.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

#: Words that a worker remembers; longer ones than `_LONGEST` are not kept.
_KNOWN = 200_000
_LONGEST = 40
#: Text bytes that are encoded together.
_TOGETHER = 2 << 20
#: What the pre-splitting of a tokenizer that drops white space must be like. Fixed values.
_DROPS_SPACE = {
    "normalizers": ["NFC", "Replace", "Lowercase"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: The same pattern for lower-case text of visible ASCII characters and composed
#: Latin-1 letters, which normalizing leaves as they are.
_LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_LATIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: visible Latin-1
    characters stand for themselves, all others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Automaton:
    """Compiled tables. A symbol is a byte, plus 256 where a word ends after it."""

    arcs: np.ndarray  # (node * 512 + symbol) of the trie's arcs, sorted
    nodes: np.ndarray  # node each of them leads to
    tokens: np.ndarray  # token that a node spells, or -1
    places: np.ndarray  # number of a token among the labels
    edges: np.ndarray  # state * size + number: beginnings and ends of closed ranges, alternating
    start: int  # state before the first token

    @property
    def size(self) -> int:
        return self.start + 1

    def follow(self, nodes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the trie goes on, and to which nodes."""
        keys = nodes * 512 + symbols
        at = np.searchsorted(self.arcs, keys)
        at[at == len(self.arcs)] = 0
        found = self.arcs[at] == keys
        return found, self.nodes[at]

    def open(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether the states have arcs for the tokens."""
        return np.searchsorted(self.edges, states * self.size + self.places[tokens], side="right") % 2 == 0

    def encode(self, words: list[bytes], has_end: bool) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one word after the other, and their numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if not len(symbols):
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        last = np.repeat(ends, sizes)
        if has_end:
            symbols[ends[sizes > 0] - 1] += 256
        # Labels that can be read from each place.
        at = np.arange(len(symbols))
        node, length, arcs = np.zeros(len(symbols), np.int64), 0, []
        while len(at):
            found, to = self.follow(node, symbols[at + length])
            at, node, length = at[found], to[found], length + 1
            token = self.tokens[node]
            spelled = token >= 0
            arcs.append((at[spelled], np.full(spelled.sum(), length), token[spelled]))
            inside = at + length < last[at]
            at, node = at[inside], node[inside]
        origin, width, token = (np.concatenate(c) for c in zip(*arcs))
        # Places are visited from the words' beginnings on; all words at once.
        depth = origin - np.repeat(begins, sizes)[origin]
        order = np.argsort(depth, kind="stable")
        origin, width, token = origin[order], width[order], token[order]
        steps = np.append(np.flatnonzero(np.diff(depth[order], prepend=-1)), len(order))
        # The state of a place is the token that ends there; a word begins before its first place.
        shift = np.repeat(np.arange(len(words)), sizes)
        state = np.full(len(symbols) + len(words), -1)
        state[begins + np.arange(len(words))] = self.start
        here = origin + shift[origin]
        for one, two in zip(steps, steps[1:]):
            part = slice(one, two)
            taken = self.open(state[here[part]], token[part])
            state[(here[part] + width[part])[taken]] = token[part][taken]
        # The arcs taken, from the last one back.
        spans = self.spans
        live = np.flatnonzero(sizes > 0)
        place, counts, out = ends[live] + live, np.zeros(len(words), np.int64), []
        while len(live):
            token = state[place]
            out.append((live, token))
            counts[live] += 1
            place = place - spans[token]
            more = place > begins[live] + live
            live, place = live[more], place[more]
        owner, token = (np.concatenate(c) for c in zip(*out))
        # Found backwards: the first of a word comes last.
        order = np.argsort(owner[::-1], kind="stable")
        return token[::-1][order], counts

    @property
    def spans(self) -> np.ndarray:
        """Symbols of each token."""
        if not hasattr(self, "_spans"):
            depth = np.zeros(len(self.tokens), np.int64)
            for arc, node in sorted(zip(self.arcs.tolist(), self.nodes.tolist()), key=lambda a: a[1]):
                depth[node] = depth[arc >> 9] + 1
            self._spans = np.zeros(self.size, np.int64)
            known = self.tokens >= 0
            self._spans[self.tokens[known]] = depth[known]
        return self._spans


def compile_merges(symbols: dict[int, tuple[int, ...]], merges: list[tuple[int, int, int]], size: int) -> Automaton:
    """Automaton of a merge list.

    `symbols` spells every token that takes part; `merges` are (u, v, uv) in
    order of priority, parts before wholes; tokens are below `size`.
    """
    born, children = {}, {}
    for rank, (u, _, uv) in enumerate(merges):
        if uv in born:
            raise ValueError("two merges make one token")
        born[uv] = rank
        children.setdefault(u, []).append(uv)
    # Preorder numbers, children by age; `until` is where a token's tree ends.
    place, until, number = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
    for root in symbols:
        if root in born:
            continue
        stack = [(root, False)]
        while stack:
            token, done = stack.pop()
            if done:
                until[token] = number
                continue
            place[token] = number
            number += 1
            stack.append((token, True))
            stack += [(c, False) for c in reversed(children.get(token, ()))]
    # The gadgets, one after the other. A state is the list of gadgets that took arcs from it.
    states: dict[int, list[int]] = {t: [] for t in symbols if t not in born}
    low, high = np.zeros(len(merges), np.int64), np.zeros(len(merges), np.int64)
    older = dict.fromkeys(symbols, 0)  # children of a token so far
    for rank, (u, v, uv) in enumerate(merges):
        states[uv] = states[v][:]
        states[u].append(rank)
        later = children.get(v, ())[older[v] :]  # the pair's own token too, where u is v
        low[rank], high[rank] = (place[later[0]], until[v]) if later else (0, 0)
        older[u] += 1
    owner = np.repeat(list(states), [len(g) for g in states.values()]).astype(np.int64)
    gadget = np.fromiter((g for gs in states.values() for g in gs), np.int64, len(owner))
    taken = place[[v for _, v, _ in merges]][gadget] if merges else np.empty(0, np.int64)
    base = owner * (size + 1)
    begin = np.concatenate([base + taken, base + low[gadget]])
    end = np.concatenate([base + taken + 1, base + high[gadget]])
    some = begin < end
    begin, end = begin[some], end[some]
    order = np.argsort(begin)
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    # Ranges that touch or overlap become one.
    new = np.append(True, begin[1:] > end[:-1]) if len(begin) else np.empty(0, bool)
    final = np.append(new[1:], True) if len(begin) else new
    edges = np.stack([begin[new], end[final]], axis=1).ravel()
    # The trie of the labels.
    trie: dict[int, int] = {}
    spelled = [-1]
    for token, letters in symbols.items():
        node = 0
        for s in letters:
            key = node * 512 + s
            node = trie.get(key)
            if node is None:
                node = trie[key] = len(spelled)
                spelled.append(-1)
        spelled[node] = token
    keys = np.array(list(trie), np.int64)
    order = np.argsort(keys)
    return Automaton(keys[order], np.array(list(trie.values()), np.int64)[order], np.array(spelled), place, edges, size)


def _taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of `flat` at `starts`, one after the other."""
    ends = np.cumsum(sizes)
    total = ends[-1] if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - ends + sizes, sizes)]


class _Store:
    """Numbered token sequences."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, names: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.number)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while first + len(names) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[first : first + len(names)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(names)] = sizes
        self.number.update(zip(names, range(first, first + len(names))))
        self.used += len(flat)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        return _taken(self.flat, self.starts[numbers], sizes), sizes

    @property
    def full(self) -> bool:
        return len(self.number) > _KNOWN or self.used > 8 * _KNOWN


class Codec:
    """Encoder of one tokenizer file with byte-level BPE.

    White space splits the words of a tokenizer whose normalizer and splitting
    drop it; for any other one whole texts are split by the file's own rules.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        bare = [k for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback") if model.get(k)]
        if model["type"] != "BPE" or bare:
            raise ValueError(f"not a plain BPE model: {bare or model['type']}")
        for token in parts["added_tokens"]:
            if token["normalized"] or token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"added token {token['content']} is not matched as it stands")
        self._tools = Tokenizer.from_file(path)
        self._added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._apart = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self._added else None
        kinds = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        pattern = [p.get("pattern", {}).get("Regex") for p in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        spaced = any(c.isspace() for t in self._added for c in t)
        self.drops_space = kinds == _DROPS_SPACE["normalizers"] and pattern[:1] == [_DROPS_SPACE["pattern"]] and not spaced
        self._suffix = model.get("end_of_word_suffix") or ""
        self._letters = byte_letters()
        vocab = model["vocab"]
        self.automaton = self._compiled(vocab, [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
        self._forget()

    def _compiled(self, vocab: dict[str, int], merges: list[list[str]]) -> Automaton:
        def symbols(token: str) -> tuple[int, ...]:
            ends = bool(self._suffix) and token.endswith(self._suffix) and token != self._suffix
            spelled = [self._letters[c] for c in (token[: -len(self._suffix)] if ends else token)]
            return (*spelled[:-1], spelled[-1] + 256) if ends else tuple(spelled)

        size = max(vocab.values()) + 1
        numbered = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        taking = {t for m in numbered for t in m} | {vocab[c + e] for c in self._letters for e in {"", self._suffix} if c + e in vocab}
        spelled = {i: symbols(t) for t, i in vocab.items() if i in taking}
        if sum(len(s) == 1 for s in spelled.values()) < 256 * (2 if self._suffix else 1):
            raise ValueError("not all bytes are tokens")
        return compile_merges(spelled, numbered, size)

    def _forget(self) -> None:
        self._words, self._parts = _Store(), _Store()

    def _split(self, text: str) -> list[str]:
        """Parts of a text by the file's own rules, as latin-1 strings of their bytes."""
        if self._tools.normalizer:
            text = self._tools.normalizer.normalize_str(text)
        found = self._tools.pre_tokenizer.pre_tokenize_str(text)
        return ["".join(chr(self._letters[c]) for c in piece) for piece, _ in found]

    def _parts_of(self, word: str) -> list[str | int]:
        """Parts of a word; an added token is its id."""
        if self._apart and "<" in word and self._apart.search(word):
            pieces = [p for p in self._apart.split(word) if p]
            return [x for p in pieces for x in ([self._added[p]] if p in self._added else self._parts_of(p))]
        if self.drops_space and _LATIN.fullmatch(word):
            found = _LATIN_PARTS.findall(word.lower())
            return found if word.isascii() else [p.encode().decode("latin-1") for p in found]
        return self._split(word) if word else []

    def _numbers(self, parts: list[str | int]) -> np.ndarray:
        """Numbers of parts; those not met before are encoded."""
        known = self._parts.number
        new = [p for p in dict.fromkeys(parts) if p not in known]
        if new:
            ids = [p for p in new if isinstance(p, int)]
            plain = [p for p in new if isinstance(p, str)]
            flat, sizes = self.automaton.encode([p.encode("latin-1") for p in plain], bool(self._suffix))
            self._parts.add(plain, flat, sizes)
            self._parts.add(ids, np.array(ids, np.int64), np.ones(len(ids), np.int64))
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts and their counts, by splitting and walking."""
        parts = [self._parts_of(t) for t in texts]
        flat, sizes = self._parts.of(self._numbers([p for own in parts for p in own]))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        sums = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return flat, np.diff(sums)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and the number of each; null is empty."""
        if self._words.full or self._parts.full:
            self._forget()
        texts = texts.fill_null("")
        if not self.drops_space:
            return self._encoded(texts.to_pylist())
        # A blank or line feed always ends a word; other white space is the splitting's to treat.
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        counts = split.value_lengths().to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self._words.number
        new = [w for w in words if w not in known]
        if new:
            self._words.add(new, *self._encoded(new))
        numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        flat, sizes = self._words.of(numbers[coded.indices.to_numpy(zero_copy_only=False)])
        for word in new:
            if len(word) > _LONGEST:  # comes once; its number stays taken
                known[f"\n{known.pop(word)}"] = -1
        sums = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return flat, np.diff(sums)


class Labels:
    """What the arcs of a tokenizer file emit."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        if parts["decoder"] is not None and parts["decoder"]["type"] != "ByteLevel":
            raise ValueError("decoder is neither absent nor byte-level")
        letters, added = byte_letters(), {t["content"]: t["id"] for t in parts["added_tokens"]}
        # Without a decoder labels are emitted as written with blanks between, else as bytes.
        self._joint = b" " if parts["decoder"] is None else b""
        labels = parts["model"]["vocab"] | added
        self._labels = [b""] * (max(labels.values(), default=-1) + 1)
        for token, i in labels.items():
            whole = self._joint or token in added or any(c not in letters for c in token)
            self._labels[i] = token.encode() if whole else bytes(letters[c] for c in token)

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of ids, as UTF-8; bytes that are none are replaced."""
        out = self._joint.join(map(self._labels.__getitem__, ids.tolist()))
        return out if self._joint else out.decode("utf-8", "replace").encode()


@lru_cache
def codec(path: str) -> Codec:
    """The codec of a tokenizer file, compiled once in a worker."""
    return Codec(path)


@lru_cache
def labels(path: str) -> Labels:
    return Labels(path)


def _portions(batch: pa.RecordBatch, column: int, most: int):
    """Slices of a batch of about `most` bytes in a column, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _encode(path: str):
    def run(batches):
        own = codec(path)
        for batch in batches:
            for part in _portions(batch, 1, _TOGETHER):
                ids, counts = own.encode(part.column(1))
                offsets = np.append(0, np.cumsum(4 * counts))
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), data.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"]
                )

    return run


def _decode(path: str):
    def run(batches):
        own = labels(path)
        for batch in batches:
            for part in _portions(batch, 2, _TOGETHER):
                texts = [own.decode(np.frombuffer(ids, "<u4")) if ids is not None else b"" for ids in part.column(2).to_pylist()]
                decoded = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of whole texts: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers).

    As the tokenizers library encodes without special tokens of its own, also
    in that added tokens are found in texts. Null and empty texts have no ids.
    Rows stay as many as they are, null and repeated ids too; other columns
    are not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_encode(tokenizer_path), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows of `encode` with the decoded text: the labels of the ids, added
    tokens too. Null ids decode to an empty text."""
    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(_decode(tokenizer_path), "doc_id long, n_tokens long, ids binary, decoded string")
