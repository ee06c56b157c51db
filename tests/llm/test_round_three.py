"""Fill-in-the-middle, vector codes and the tokenization automaton against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_operators import ROWS

TRICKY = [
    (200, "a<P>b"), (201, "<S>"), (202, "<M" * 40), (203, "x<"), (204, "<P<S<M" * 9), (205, "é你🙂" * 30_000), (None, "no id at all"),
    (None, "no id at all"), (5, ROWS[5][1]), (206, "it's THEY'LL <|endoftext|>x<|startoftext|> <|endof"), (207, "ﬁ Ⅷ ½ é ẞİK ΑΣ x\x1cy\x85z"),
    (208, "ab" * 4000), (209, " \t\r\n\n  x  "), (210, "1234 56,78!!?'s''s 's-'ll Straße ñandú Ürümqi"),
]


@pytest.fixture(scope="module")
def docs(spark):
    kind = "doc_id long, text string, n string, form int, ids string, label string, code int"
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 2) for i, t in ROWS + TRICKY], kind)


# --- fill in the middle


def _fim(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(docs):
    from tidemark.llm import fill_in_middle as fim

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = sorted(map(tuple, fim.digests(docs, partitions=3).collect()), key=str)
    want = [(i, *_fim(i, t)[:4], sha(_fim(i, t)[4]), sha(t or "")) for i, t in ROWS + TRICKY]
    assert found == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}

    outputs = fim.transform(docs)
    assert sorted(map(tuple, outputs.collect()), key=str) == sorted(((i, *_fim(i, t)) for i, t in ROWS + TRICKY), key=str)
    back = fim.restore(outputs).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in ROWS + TRICKY), key=str)
    assert fim.digests(docs.filter("false")).collect() == [] == fim.transform(docs.filter("false")).collect()


def test_fill_in_middle_sorts_again_without_moving(docs):
    from tidemark.llm import fill_in_middle as fim

    one = fim.pieces(docs, partitions=5)
    two = one.mapPartitions(lambda x: x, preservesPartitioning=True).repartitionAndSortWithinPartitions(5, fim._spread)
    assert two.toDebugString().decode().count("ShuffledRDD") == one.toDebugString().decode().count("ShuffledRDD") == 1


@given(st.text("<PSM>ab", max_size=12), st.text("<PSM>ab", max_size=12), st.text("<PSM>ab", max_size=12), st.integers(1, 5), st.booleans())
def test_marks_are_found_across_chunks(p, m, s, size, spm):
    from tidemark.llm.fill_in_middle import parts_of

    if any(x in p + m + s or x in p or x in m or x in s for x in ("<P>", "<S>", "<M>")):
        return
    output = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    chunks = [output[i : i + size] for i in range(0, len(output), size)]
    found = ["", "", ""]
    for place, chunk in parts_of("spm" if spm else "psm", chunks):
        found[place] += chunk
    assert found == [p, m, s]


# --- vector codes


def _codes(rows, parts=16, entries=64, rounds=2):
    good = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(first[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in first[:entries]] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    assign = lambda v: [min(range(len(books[p])), key=lambda k: (far(cut(v)[p], books[p][k]), k)) for p in range(parts)]
    for _ in range(rounds):
        codes = [assign(v) for _, v, _ in good]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v)[p] for (_, v, _), c in zip(good, codes) if c[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out, totals = [], {}
    for i, v, label in good:
        code = assign(v)
        error = sum(far(cut(v)[p], books[p][k]) for p, k in enumerate(code))
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for k in code), error, label))
    return [(i, c, e, totals[label]) for i, c, e, label in out], np.array(books)


def _vectors(n, width=32, seed=3):
    draw = np.random.default_rng(seed)
    return [(i, draw.normal(size=width).round(2 if i % 2 else 1).tolist(), int(i % 3) if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 9, 300])
def test_vector_codes(spark, n):
    from tidemark.llm.vector_codes import compress, with_label_errors

    rows = _vectors(n)
    rows += rows[: n // 3] + [(None, rows[0][1], None), (10**6, rows[-1][1], 7)]
    bad = [
        (-1, None, 1), (-2, [None] * 32, 1), (-3, [float("nan")] * 32, 1), (-4, [1.0] * 31 + [float("inf")], 1),
        (900, [1.0] * 16, 1), (901, [1.0] * 20, 1), (902, [], 1), (903, [1e30] * 32, 1),
    ]
    kind = "vec_id long, embedding array<double>, label int, code int, salt int, error string, v int"
    frame = spark.createDataFrame([(*r, 1, 2, "e", 3) for r in rows + bad], kind)
    coded, books = compress(frame)
    want, want_books = _codes(rows)
    assert np.array_equal(books, want_books)
    found = with_label_errors(coded).select("vec_id", "code", "error", "label_error").collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_vector_codes_of_nothing(spark):
    from tidemark.llm.vector_codes import codebooks_digest, compress, with_label_errors

    coded, books = compress(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int"))
    assert with_label_errors(coded).collect() == [] and codebooks_digest(books) == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("seed", range(6))
def test_bounds_never_miss_the_nearest_entry(seed):
    from tidemark.llm import vector_codes as vc

    draw = np.random.default_rng(seed)
    x = draw.integers(-20, 20, (400, 3)) * (10**6 if seed == 5 else 1)
    book = x[:40].copy()
    bounds, b = vc.searched(x, book, 10), 10
    for step in range(6):
        new = book + draw.integers(-2, 3, book.shape) * (0 if step == 3 else 1)
        moves = vc._up(np.sqrt(((new - book) ** 2).sum(1).astype(float)))
        b = max(3, b - 2)
        bounds, depth = vc.moved(x, new, moves, bounds, b)
        exact = vc.squared(x, new)
        assert np.array_equal(bounds.code, exact.argmin(1)) and depth <= b
        assert (bounds.low <= np.sqrt(np.take_along_axis(exact, bounds.near.astype(int), 1))).all()
        rest = exact.copy()
        np.put_along_axis(rest, bounds.near.astype(int), np.iinfo(np.int64).max, 1)
        np.put_along_axis(rest, bounds.code.astype(int)[:, None], np.iinfo(np.int64).max, 1)
        assert (bounds.outer <= np.sqrt(rest.min(1))).all()
        book = new


# --- tokenization automaton


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_like_the_library(spark, docs, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.bpe_automaton import decode, encode

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    found = decode(encode(docs, path), path).collect()
    want = []
    for i, text in ROWS + TRICKY:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in found), key=str) == sorted(want, key=str)
    assert decode(encode(docs.filter("false"), path), path).collect() == []


def _merged(word, merges):
    """Byte-pair encoding as it is defined: the best pair first, from the left."""
    parts = list(word)
    while True:
        pairs = [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_automaton_equals_merging(seed):
    from tidemark.llm.bpe_automaton import compile_merges

    draw = random.Random(seed)
    tokens = ["a", "b", "c"]
    pairs = []
    for _ in range(draw.randrange(25)):
        u, v = draw.choice(tokens), draw.choice(tokens)
        if u + v not in tokens and len(u + v) < 9:
            pairs.append((u, v))
            tokens.append(u + v)
    number = {t: i for i, t in enumerate(tokens)}
    spelled = {i: tuple(t.encode()) for t, i in number.items()}
    automaton = compile_merges(spelled, [(number[u], number[v], number[u + v]) for u, v in pairs], len(tokens))
    rank = {p: i for i, p in enumerate(pairs)}
    words = ["".join(draw.choice("abc" if draw.random() < 0.5 else "aab") for _ in range(draw.randrange(14))) for _ in range(40)]
    flat, counts = automaton.encode([w.encode() for w in words], False)
    at = 0
    for word, n in zip(words, counts):
        assert [tokens[t] for t in flat[at : at + n]] == _merged(word, rank)
        at += n


def test_codec_forgets_and_goes_on():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm import bpe_automaton

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe_automaton.Codec(path), Tokenizer.from_file(path)
    draw = random.Random(1)
    texts = [" ".join("".join(draw.choices("aeinrst<>|é'9", k=draw.choice([1, 4, 60]))) for _ in range(30)) for _ in range(12)]
    for text in texts + texts:
        own._words.number.update({f"filler {i}": 0 for i in range(bpe_automaton._KNOWN + 1)} if draw.random() < 0.2 else {})
        flat, counts = own.encode(pa.array([text, None]))
        assert flat.tolist() == library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(flat), 0]


# --- toxicity: the fit against its definition, and the sample's bound


def test_toxicity_fit_minimises_its_loss():
    """Loss with explicit swapped sentences, minimised by plain gradient steps."""
    from tidemark.llm import toxicity as tox

    words = ["hate", "love", "women", "men", "people", "tree", "stone"]
    draw = random.Random(4)
    texts = [" ".join(draw.sample(words, 3)) for _ in range(60)]
    labels = np.array([float("hate" in t or ("women" in t and draw.random() < 0.7)) for t in texts])
    known = np.unique(np.concatenate([tox.features(w) for w in words] + [tox._term(t) for g in tox.GROUPS for t in g]))
    rows = [np.searchsorted(known, f) for f in map(tox.features, texts)]
    got_w, got_b = tox._fit(np.concatenate(rows), np.array([len(r) for r in rows]), labels, known)

    x = np.zeros((len(texts), len(known)))
    for i, r in enumerate(rows):
        x[i, r] = 1
    swaps = []
    for group in tox.GROUPS:
        for term in group:
            mine = np.searchsorted(known, tox._term(term))
            times = max(1, int(x[:, mine].sum(0).min()))
            for other in group:
                if other != term:
                    d = np.zeros(len(known))
                    np.add.at(d, np.searchsorted(known, tox._term(other)), 1)
                    np.add.at(d, mine, -1)
                    swaps.append(d * np.sqrt(times / (len(group) - 1) / len(texts)))
    swaps = np.array(swaps)

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)) + tox.RIDGE / 2 * w @ w + tox.COUNTERFACTUAL / 2 * ((swaps @ w) ** 2).sum()

    w, b = np.zeros(len(known)), 0.0
    for _ in range(20_000):
        e = 1 / (1 + np.exp(-(x @ w + b))) - labels
        w, b = w - 0.2 * (x.T @ e / len(texts) + tox.RIDGE * w + tox.COUNTERFACTUAL * swaps.T @ (swaps @ w)), b - 0.2 * e.mean()
    assert loss(got_w, got_b) <= loss(w, b) * 1.01 + 1e-4
    scores = tox.Model(known, got_w, got_b).score(["women tree", "men tree", "hate tree"])
    assert abs(scores[0] - scores[1]) < 0.1 < scores[2] - scores[0]


def test_labelled_sample_is_bounded(spark, monkeypatch):
    from tidemark.llm import toxicity as tox

    monkeypatch.setattr(tox, "SAMPLE_ROWS", 20)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text", "id AS label")
    hot = spark.range(900).selectExpr("cast(7 AS long) AS doc_id", "'the same' AS text", "id AS label")
    none = spark.createDataFrame([(None, "x", 1), (3, None, 1)], "doc_id long, text string, label long")
    labels = spark.range(400).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS label").union(spark.createDataFrame([(None, 1), (4, None)], "doc_id long, label int"))
    rows = tox.labelled_sample(docs.union(hot).union(none), labels.union(labels)).collect()
    assert 5 <= len(rows) <= 40 and all(r.text and r.label in (0, 1) for r in rows)
    assert len({r.text for r in rows}) == len(rows)
    assert tox.labelled_sample(docs.filter("false"), labels).collect() == []
    with pytest.raises(ValueError, match="labelled_sample"):
        tox.train(docs.select("text", F.lit(1).alias("label")))
