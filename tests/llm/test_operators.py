"""Every operator against a plain version on small tables that hold nulls,
empty and long texts, ties, repeated rows and columns of clashing names."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

WORDS = "the of and house green river tree idea small wonderful stone paper light machine moon winter sugar engine cloud forest".split()


def _text(draw, words):
    return " ".join(draw.choice(WORDS) + (str(draw.randint(0, 99)) if draw.random() < 0.5 else "") for _ in range(words))


def _rows():
    draw = random.Random(5)
    rows = [(i, _text(draw, draw.choice([1, 3, 20, 60, 200]))) for i in range(60)]
    for i in range(60, 120):  # near copies of each other and of earlier rows
        words = rows[draw.randrange(10) if i < 100 else draw.randrange(i)][1].split(" ")
        for _ in range(draw.choice([0, 1, 2, 6])):
            words[draw.randrange(len(words))] = "edit" + str(draw.randint(0, 9))
        rows.append((i, " ".join(words)))
    passage = _text(draw, 90)
    rows += [(i, _text(draw, 30) + " " + passage + " " + _text(draw, 30)) for i in range(120, 126)]
    rows += [(130, None), (131, ""), (132, " \t\n"), (133, "one"), (134, "one"), (135, "ONE two"), (136, "!?."), (137, "é ß 你好 🙂 " * 40)]
    rows += [(140, "long " + _text(draw, 9000)), (141, "ab" * 3000)]
    return rows


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    extra = "doc_id long, text string, source string, length int, score string, bin int, cls string, n_bytes string, word string"
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 7 else None, 1, "x", 2, "c", "b", "w") for i, t in ROWS], extra)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


# --- token files


def test_sampled_pieces_are_spread_over_the_document():
    from tidemark.llm.token_files import SAMPLE_BYTES, SAMPLE_PIECES, _pieces

    assert _pieces(b"") == b"" and _pieces(b"x" * SAMPLE_BYTES) == b"x" * SAMPLE_BYTES
    data, size = np.arange(300_001, dtype="<u4").tobytes(), SAMPLE_BYTES // SAMPLE_PIECES
    ids = np.frombuffer(_pieces(data), "<u4").reshape(SAMPLE_PIECES, size // 4)
    assert ids[0, 0] == 0 and ids[-1, -1] == 300_000 and (np.diff(ids, axis=1) == 1).all() and (np.diff(ids[:, 0]) > 40_000).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files(spark, docs, empty, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.token_files import Encoder, read_token_files, scratch_folder, write_token_files

    path = public_tokenizers.path(name)
    assert Encoder(path).by_words == (name == "word_bpe_49k.json")
    plain, folder = Tokenizer.from_file(path), scratch_folder(spark)
    write_token_files(docs.union(docs.filter("doc_id = 3")), folder, path, end_id=2)
    got = read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    texts, at = sorted([*ROWS, *(r for r in ROWS if r[0] == 3)], key=lambda r: r[0]), 0
    assert len(got) == len(texts)
    for row, (doc_id, text) in zip(got, texts):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, at, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    some = read_token_files(spark, folder, with_ids=True, doc_ids=[140, 130]).collect()
    assert {r.doc_id: r.ids for r in some} == {r.doc_id: r.ids for r in got if r.doc_id in (140, 130)}
    none = scratch_folder(spark)
    write_token_files(empty, none, path, end_id=2)
    assert read_token_files(spark, none).count() == 0


# --- language


def test_language(spark):
    from tidemark.llm import language

    letters = {"aa": "banana papaya salsa mama", "bb": "strength brisk crypt thump", "cc": "queue ouija aioli eerie"}
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice(t.split()) for _ in range(30)), k) for i, (k, t) in enumerate(list(letters.items()) * 20)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(train.union(spark.createDataFrame([(99, None, "aa"), (98, "x", None), (97, "12 34", "dd")], train.schema)))
    assert model.languages == ["aa", "bb", "cc"]
    tests = [(1, "papaya banana", "aa"), (2, "crypt brisk", "bb"), (3, "ouija queue " * 5000, "cc"), (4, None, "und"), (5, "", "und"), (6, "12 !?", "und"), (None, "mama", "aa")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t, _ in tests], "doc_id long, text string, score int, lang_pred int")
    got = {r.doc_id: r for r in language.detect(frame, model).collect()}
    assert {i: got[i].lang_pred for i, _, _ in tests} == {i: w for i, _, w in tests}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[4].score == 0
    assert language.detect(frame.filter("false"), model).count() == 0
    nothing = language.train(train.filter("false"))
    assert {r.lang_pred for r in language.detect(frame, nothing).collect()} == {"und"}
    one = language.train(train.filter("lang = 'aa'"))
    assert {r.lang_pred for r in language.detect(frame.filter("doc_id < 4"), one).collect()} == {"aa"}


def test_codewords_correct_errors():
    from tidemark.llm.language import codewords

    for k in (2, 3, 4, 6, 12):
        code = codewords(k)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(apart) >= (1 if k == 2 else 2)
        assert all(abs(c.sum()) < k for c in code.T)


# --- pages


def _page(body, n):
    return (
        f"<html><head><title>T{n}</title><style>p{{}}</style></head><body><nav><a href=/x>Menu {n}</a></nav><header>Site</header>"
        f"<div class='cookie-notice'>We use cookies {n}</div><div class=z><p>Stay up to date</p></div>{body}<div class='ad box'>Buy {n}</div>"
        f"<form>Name <input></form><script>var t='</p>';</script><section id=comments><p>Reader {n}</p></section><footer>&copy; {n}</footer></body></html>"
    )


def test_pages(spark):
    from tidemark.llm.pages import extract

    rows = [(n, f"https://h.example/{n}", _page(f"<div class=z><p>Text {n} &amp;\n more<br>line<p>Second <b>b</b>old {n}</div>", n)) for n in range(8)]
    want = {n: f"Text {n} & more line Second bold {n}" for n in range(8)}
    rows += [(20, "http://H.example/a", _page("<article><h1>Head</h1><p>Own words</article>", 9)), (21, "https://other/x", "<p>alone &#8364;<p>b")]
    want |= {20: "Head Own words", 21: "alone € b"}
    rows += [(30, None, None), (31, "nonsense", ""), (32, "https://h.example/q", "<nav>only menu"), (33, "https://h.example/w", "a < b <p title='x>y"), (3, rows[3][1], rows[3][2])]
    rows += [(34, "https://x.example/l", "<p>" + "long text " * 20000)]
    want |= {30: "", 31: "", 32: "", 33: "a < b y", 34: "long text " * 19999 + "long text"}
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    got = extract(frame).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract(frame.filter("false")).count() == 0


def test_simple_tree_matching():
    from tidemark.llm.pages import Page, align

    one, two = Page("<div><p>a</p><ul><li>x</ul></div>").folded()[0], Page("<div><h1>t</h1><p>b</p><table></table><ul><li>y<li>z</ul></div>").folded()[0]
    flat = lambda t: {t[1]: t[0]} | {k: v for c in t[2] for k, v in flat(c).items()}
    names, others = flat(one), flat(two)
    pairs = align(one, two)
    assert len(pairs) == len(names) and all(names[a] == others[b] for a, b in pairs.items())


# --- decontamination


def test_decontamination(spark, docs, empty):
    from tidemark.llm.decontaminate import contaminated, drop_contaminated

    texts = dict(ROWS)
    items = [(1, " ".join(texts[120].split()[28:80])), (2, " ".join(texts[140].split()[500:540])), (3, None), (4, ""), (5, "one"), (6, "nobody has this sentence of words"), (7, "one two")]
    items += [(8, " ".join(texts[140].split()[700:780]).replace(texts[140].split()[740], "changed"))]
    bench = spark.createDataFrame([(*i, 9) for i in items] + [(*items[0], 9)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.start, r.n_words) for r in contaminated(docs.union(docs.filter("doc_id = 121")), bench).collect())
    want = sorted(brute.contaminated(ROWS, items))
    assert got == want and {1, 2, 5, 7} <= {g[1] for g in got}
    bad = {g[0] for g in got}
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == sorted(i for i, _ in ROWS if i not in bad)
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.filter("false")).count() == 0


def test_decontamination_without_bitmap(spark, docs, monkeypatch):
    from tidemark.llm import decontaminate

    bench = spark.createDataFrame([(1, " ".join(dict(ROWS)[120].split()[28:80]))], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BITMAP_SHINGLES", 3)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole and whole


def test_decontamination_of_repetitive_passages(spark):
    from tidemark.llm.decontaminate import _numbered, contaminated

    draw = random.Random(8)
    items, rows = [], []
    for i in range(6):
        words = [f"w{draw.randrange(10**6)}" for _ in range(454)]
        at = draw.randrange(20, 380)
        items.append((i, " ".join(words)))
        rows.append((i, " ".join(["start"] * 9 + words[:at] + ["la"] * 42 + words[at + 42 :] + ["end"] * 9)))
    items.append((9, " ".join(["la"] * 60 + [f"x{k}" for k in range(40)])))
    rows.append((9, " ".join(["la"] * 55 + [f"x{k}" for k in range(40)])))
    frames = [spark.createDataFrame(x, f"{k} long, text string") for x, k in ((rows, "doc_id"), (items, "item_id"))]
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.start, r.n_words) for r in contaminated(*frames).collect())
    assert got == sorted(brute.contaminated(rows, items)) and len(got) == 7

    bag = spark.createDataFrame([(1, [5, 3, 5, 5]), (2, [3, 5, 5]), (3, [4, 6])], "k long, shingles array<long>")
    one, two, three = (set(r.h) for r in _numbered(bag, ["k"]).orderBy("k").collect())
    assert len(one) == 4 and two < one and {3, 5} < two and three == {4, 6}


# --- toxicity


def test_toxicity(spark):
    from tidemark.llm import toxicity

    draw = random.Random(2)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        words = [draw.choice(WORDS) for _ in range(20)]
        if bad:
            words += ["vile" + draw.choice("abcdefghij")]
        # One group is named in most bad sentences, the other in good ones.
        words += ["women" if bad == (draw.random() < 0.9) else "men"]
        rows.append((i, " ".join(words), int(bad), "x"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int, score string")
    model = toxicity.train(frame.union(spark.createDataFrame([(900, None, 1, ""), (901, "a", None, "")], frame.schema)))
    tests = [(1, "the vilez river", 1), (2, "green river house", 0), (3, None, 0), (4, "", 0), (5, "women and men of the house", 0), (6, "stone " * 50000, 0)]
    scored = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([(i, t, "y") for i, t, _ in tests], "doc_id long, text string, predicted string"), model).collect()}
    assert {i: scored[i].predicted for i, _, _ in tests} == {i: w for i, _, w in tests}
    swapped = model.score(["women of the house", "men of the house"])
    assert abs(swapped[0] - swapped[1]) < 0.05
    assert toxicity.score(frame.filter("false"), model).count() == 0
    assert toxicity.train(frame.filter("false")).score(["x", None]) == [0.5, 0.5]


# --- near duplicates


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, empty, words):
    from tidemark.llm.near_duplicates import near_duplicates

    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, words=words).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in brute.near_duplicates(ROWS, words).items()}
    assert got == want
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_without_ids(spark):
    from tidemark.llm.near_duplicates import near_duplicates

    frame = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "x y z"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame, words=2).collect())
    assert got == Counter({(None, 5, False): 1, (5, 5, True): 2, (None, None, True): 2})


def test_sketches_fill_and_estimate():
    from tidemark.llm.near_duplicates import sketches

    draw = np.random.default_rng(0)
    for size in (1, 5, 3000):
        common = draw.integers(0, 2**63, size, dtype=np.uint64)
        own = [draw.integers(0, 2**63, size, dtype=np.uint64) for _ in range(2)]
        one, two = sketches([np.r_[common, own[0]], np.r_[common, own[1]]], 256)
        assert (one != np.uint64(2**64 - 1)).all()
        assert abs((one == two).mean() - 1 / 3) < 0.15


def test_components(spark):
    from tidemark.llm.common import components

    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for pair in links for x in pair}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in links)}


# --- packing


def test_packing(docs, empty):
    from tidemark.llm.packing import best_fit

    got = best_fit(docs, capacity=100).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    source = {i: (f"s{i % 3}" if i % 7 else None) for i, _ in ROWS}
    text = dict(ROWS)
    for r in got:
        by_doc[r.doc_id].append((r.start, r.length))
        bins[r.bin_id].append(r)
    for doc_id, t in ROWS:
        pieces, at = sorted(by_doc[doc_id]), 0
        for start, length in pieces:
            assert start == at and 0 < length <= 100
            at += length
        assert at == len((t or "").split()) + 1
    for rows in bins.values():
        assert sum(r.length for r in rows) == rows[0].bin_length <= 100
        at = 0
        for r in sorted(rows, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        sources = [source[r.doc_id] for r in rows if source[r.doc_id]]
        texts = [text[r.doc_id] for r in rows if text[r.doc_id]]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)
    assert best_fit(empty).count() == 0


def test_near_copies_are_packed_apart(spark, tmp_path):
    from tidemark.llm.queries import op7

    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(60)]
    rows = [(None if i % 4 == 0 else i // 2, " ".join([*base[:-1], f"end{i}"]), f"s{i}") for i in range(12)]
    rows += [(50 + i, _text(draw, 60), f"t{i}") for i in range(12)] + [(None, None, "u"), (None, " ", "v")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op7(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(r.length for r in got) == sum(len((t or "").split()) + 1 for _, t, _ in rows)
    near = Counter(r.bin_id for r in got if r.length == 61 and (r.doc_id is None or r.doc_id < 50))
    assert sum(near.values()) == 12 and set(near.values()) == {1}


def test_words_are_counted_once(spark):
    from tidemark.llm.near_duplicates import near_duplicates
    from tidemark.llm.packing import best_fit

    rows = ROWS + [(None, "a b\tc"), (None, "a b\tc"), (900, "é\u00a0x y\x0bz"), (901, " \n")]
    docs = spark.createDataFrame([(i, t, f"s{(i or 0) % 3}") for i, t in rows], "doc_id long, text string, source string")
    near = near_duplicates(docs, words=5, with_texts=True).select("doc_id", "text_hash", F.hex("component").alias("cluster"), "n_words")
    got = best_fit(docs, capacity=100, clusters=near)
    again = best_fit(docs, capacity=100, clusters=near.drop("n_words").filter("cluster IS NOT NULL"))
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" in plan(again) and "regexp" not in plan(got)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, again.collect()))
    with pytest.raises(Exception, match="without n_words"):
        best_fit(docs, clusters=near.filter("n_words < 5")).collect()


def test_words_of_many_texts():
    from tidemark.llm import hashing, near_duplicates

    draw = random.Random(8)
    texts = [b"", b" ", b"x", *(bytes(draw.choice(b"ab \n\t") for _ in range(draw.randint(0, 60))) for _ in range(200)), b"long " * 60_000, b"y z"]
    found = hashing.many_word_hashes(texts)
    assert [f.tolist() for f in found] == [hashing.word_hashes(t).tolist() for t in texts]
    for (at, upto, words, sets), part in zip(near_duplicates._groups(texts, 3), [texts]):
        assert (at, upto) == (0, len(texts)) and len(words) == len(sets) == len(part)
        assert [s.tolist() for s in sets] == [near_duplicates.shingle_set(t.decode(), 3).tolist() for t in texts]
        assert all(len(s) == len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else []) for s, w in zip(sets, map(bytes.split, texts)))


def test_best_fit_is_tightest():
    from tidemark.llm.packing import pack

    draw = random.Random(8)
    lengths = sorted((draw.randint(1, 60) for _ in range(400)), reverse=True)
    sources, clusters = [draw.choice([None, *range(9)]) for _ in lengths], [draw.choice([None, *range(40)]) for _ in lengths]
    room, held, want = [], [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(room[b], b) for b in range(len(room)) if room[b] >= n and not ({("s", s), ("c", c)} - {("s", None), ("c", None)}) & held[b]]
        b = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(100)
            held.append(set())
        want.append((b, 100 - room[b]))
        room[b] -= n
        held[b] |= {("s", s), ("c", c)} - {("s", None), ("c", None)}
    assert pack(lengths, sources, clusters, 100) == want


# --- fingerprints


def test_fingerprints(spark, docs, empty):
    from tidemark.llm.fingerprints import fingerprint_edits

    got = {r.doc_id: r for r in fingerprint_edits(docs).collect()}
    order = sorted((i for i, _ in ROWS), reverse=True)
    texts = {i: t or "" for i, t in ROWS}
    for at, i in enumerate(order):
        text, after = texts[i], texts[order[(at + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - brute.similarity(text, edited, 5)) < 0.17, i
        assert abs(got[i].near_next - brute.similarity(text, after, 5)) < 0.17, i
    assert got[133].fingerprint == got[134].fingerprint != got[135].fingerprint
    assert len({len(r.fingerprint) for r in got.values()}) == 2
    assert fingerprint_edits(empty).count() == 0
    single = fingerprint_edits(docs.filter("doc_id = 5")).first()
    assert single.near_next == 1.0
    ties = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (None, None), (2, "z")], "doc_id long, text string")
    assert fingerprint_edits(ties).count() == 5


def test_next_crosses_buckets(spark):
    from tidemark.llm import fingerprints

    rows = [(i * i, f"t{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.next.doc_id for r in fingerprints.with_next(frame, "doc_id", "text").collect()}
    assert got == {i * i: (i - 1) ** 2 if i else 2999**2 for i in range(3000)}


# --- repeated passages


@pytest.mark.parametrize("length,crowd", [(40, 2000), (100, 1), (400, 2000), (17, 3)])
def test_repeats(docs, length, crowd):
    from tidemark.llm.suffix_dedup import remove_repeats

    got = sorted((r.doc_id, int(r.n_bytes), r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, length, crowd=crowd).collect())
    assert got == sorted(brute.remove_repeats(ROWS, length))


def test_repeats_keep_columns(spark, docs, empty):
    from tidemark.llm.suffix_dedup import remove_repeats

    twice = docs.filter("doc_id IN (1, 130, 140)").union(docs.filter("doc_id = 140"))
    rows = remove_repeats(twice, 400).collect()
    assert Counter((r.doc_id, r.text, r.source, r.length) for r in rows)[(140, "", "s2" if 140 % 7 else None, 1)] == 2
    assert {r.text for r in rows if r.doc_id == 130} == {None}
    assert remove_repeats(empty, 400).count() == 0


def _passages(rows, words, spare=()):
    """Texts without runs of `words` words that another text has, and the bytes of those."""
    seen, copies = defaultdict(set), Counter(t for _, t in rows)
    cut = lambda t: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
    windows = lambda t: [tuple(t[a:b] for a, b in cut(t)[p : p + words]) for p in range(len(cut(t)) - words + 1)]
    for _, t in rows:
        for w in windows(t):
            seen[w].add(t)
    kept = {w for t in spare for w in windows(t)}
    out = []
    for i, t in rows:
        gone = bytearray(len(t or ""))
        for p, w in enumerate(windows(t)):
            if copies[t] > 1 or len(seen[w]) > 1 and w not in kept:
                a, b = cut(t)[p][0], cut(t)[p + words - 1][1]
                gone[a:b] = b"\1" * (b - a)
        rest = t and "".join(c for c, g in zip(t, gone) if not g)
        out.append((i, rest, len((t or "").encode()) - len((rest or "").encode())))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [6, 24, 50])
def test_passages_of_words(spark, words):
    from tidemark.llm.suffix_dedup import remove_repeats

    draw = random.Random(words)
    fresh = lambda n: " ".join(f"{draw.choice('abéñ')}{draw.randrange(10**4)}" for _ in range(n))
    common, spared, inner = fresh(words + 3), fresh(words + 1), fresh(words)
    rows = [(i, f"{fresh(i % 7)} {common.replace(' ', chr(9)) if i % 2 else common}  {fresh(i % 5)}") for i in range(6)]
    rows += [(10 + i, f"{fresh(4)} {spared} {fresh(4)}") for i in range(2)] + [(20, f"{inner} x {inner}"), (21, fresh(words)), (None, None), (22, "")]
    rows += [(23, common.rsplit(" ", 4)[0]), (24, fresh(2) + " " + " ".join(common.split()[2:]))]
    # Copies are other documents.
    rows += [(30, copy := fresh(words) + " "), (31, copy), (31, copy), (None, fresh(words + 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spare = spark.createDataFrame([(spared,), (None,), ("",)], "text string")
    for given, texts in ((spare, [spared]), (None, [])):
        got = remove_repeats(docs, 10_000, words=words, spare=given).collect()
        assert sorted(((r.doc_id, r.text, r.n_passage_bytes) for r in got), key=str) == _passages(rows, words, texts)
        assert all(r.n_removed == r.n_passage_bytes for r in got)
    # Only counted: what goes is what went before.
    plain = {tuple(r) for r in remove_repeats(docs, 40).collect()}
    beside = remove_repeats(docs, 40, words=words, cut_words=False).collect()
    assert {tuple(r)[:-1] for r in beside} == plain
    assert sorted(((r.doc_id, r.n_passage_bytes) for r in beside), key=str) == sorted(((i, n) for i, _, n in _passages(rows, words)), key=str)


def test_pipeline_cuts_passages_of_words(spark, tmp_path):
    import corpus_pipeline
    from tidemark.llm.queries import op9

    draw = random.Random(50)
    fresh = lambda n: " ".join(f"{draw.choice('abcd')}{draw.randrange(1000)}" for _ in range(n))
    passage, item = fresh(55), fresh(55)
    assert len(passage) < 400
    rows = [(1, f"{fresh(30)} {passage} {fresh(9)}"), (2, f"{passage} {fresh(30)}"), (3, fresh(90)), (4, f"{fresh(20)} {item}"), (5, f"{item} {fresh(20)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()}
    assert {i: got[i].text for i in got} == {i: t.replace(passage, "") for i, t in rows}
    assert all(r.n_chars == len(r.text) for r in got.values())
    flags = {r.doc_id: (r.has_passage, r.n_passage_bytes, r.n_removed) for r in op9(spark, str(tmp_path)).collect()}
    assert flags == {1: (True, len(passage), 0), 2: (True, len(passage), 0), 3: (False, 0, 0), 4: (True, len(item), 0), 5: (True, len(item), 0)}


@pytest.mark.parametrize("words", [6, 24])
def test_spared_words_go_beside_the_text_that_keeps_them(spark, words):
    from tidemark.llm.suffix_dedup import remove_repeats

    draw = random.Random(70 + words)
    fresh = lambda n: " ".join(f"{draw.choice('abéñ')}{draw.randrange(10**4)}" for _ in range(n))
    common, spared = fresh(words + 3), fresh(words + 2)
    both = f"{common} {spared}"  # windows over the border are no windows of the spared text
    rows = [(i, f"{fresh(i)} {common} {fresh(2)}") for i in range(2)] + [(2 + i, f"{fresh(3)} {spared} {fresh(i)}") for i in range(2)]
    rows += [(4 + i, f"{fresh(3)} {both} {fresh(3)}") for i in range(2)] + [(6, fresh(words + 9)), (7, spared + " é"), (8, None), (9, "")]
    rows += [(10, copy := f"{fresh(2)} {spared}"), (11, copy), (11, copy), (None, f"{spared} {fresh(1)} {common}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spare = spark.createDataFrame([(spared,), (spared + " " + fresh(2),), (None,)], "text string")
    got = remove_repeats(docs, 10_000, words=words, spare=spare, spared_col="seen").collect()
    assert sorted(((r.doc_id, r.text, r.n_passage_bytes) for r in got), key=str) == _passages(rows, words)
    left = _passages(rows, words, [spared])
    assert sorted(((r.doc_id, r.text if r.seen is None else r.seen) for r in got), key=str) == sorted(((i, t) for i, t, _ in left), key=str)
    assert {r.doc_id for r in got if r.seen is not None} == {2, 3, 4, 5, 7, None}
    # Only counted: nothing goes, so no other text is left.
    beside = remove_repeats(docs, 10_000, words=words, cut_words=False, spare=spare, spared_col="seen").collect()
    assert {r.seen for r in beside} == {None} and Counter(r.text for r in beside) == Counter(t for _, t in rows)
    assert sorted(((r.doc_id, r.n_passage_bytes) for r in beside), key=str) == sorted(((i, n) for i, _, n in _passages(rows, words)), key=str)


def test_pipeline_cuts_passages_of_the_benchmark(spark, tmp_path):
    import corpus_pipeline as pipeline

    draw = random.Random(51)
    fresh = lambda n: " ".join(f"{draw.choice('abcd')}{draw.randrange(1000)}" for _ in range(n))
    item, long, single = fresh(55), fresh(90), fresh(55)
    part = " ".join(long.split()[:52])  # repeats, but is too little of its item to be a leak
    rows = [
        (1, f"{fresh(30)} {item} {fresh(9)}"), (2, f"{item} {fresh(30)}"), (3, fresh(90)), (4, f"{fresh(20)} {part} {fresh(5)}"),
        (5, f"{part} {fresh(60)}"), (6, f"{fresh(10)} {single} {fresh(10)}"), (None, f"{fresh(40)} {item}"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item), (2, long), (3, single)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(pipeline.STAGES)
    stages["repeated passages"](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/cut")
    cut = spark.read.parquet(f"{tmp_path}/cut")
    want = {i: t.replace(item, "").replace(part, "") for i, t in rows}
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    # Documents that held an item go all the same, the passage cut or not.
    left = stages["benchmark decontamination"](spark, cut, str(tmp_path))
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {i: want[i] for i in (3, 4, 5)}
    # As the next stage looks at them: words of the benchmark are left in.
    seen = pipeline.cut_repeats(spark, docs, str(tmp_path))
    assert seen.columns == docs.columns and {(r.doc_id, r.text, r.n_chars) for r in seen.collect()} == {(i, t, len(t)) for i, t in rows}


def test_word_runs_of_long_texts():
    from tidemark.llm import hashing, suffix_dedup

    draw = np.random.default_rng(2)
    texts = [draw.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 9, 10, 5000, 60)]
    whole = [list(map(np.ndarray.tolist, r)) for r in suffix_dedup.word_runs(texts, 10)]
    block, suffix_dedup._BLOCK = suffix_dedup._BLOCK, 700
    try:
        cut = [list(map(np.ndarray.tolist, r)) for r in suffix_dedup.word_runs(texts, 10)]
    finally:
        suffix_dedup._BLOCK = block
    flat = lambda runs: [(t, f + i, k) for r in runs for t, f, c, k in zip(*r) for i in range(c)]
    assert flat(whole) == flat(cut) and len(cut) > 1
    assert [(t, f) for t, f, _ in flat(whole)] == [(t, p) for t, x in enumerate(texts) for p in range(len(x) - 9)]
    text = b" ".join(b"w%d" % i for i in range(40))
    found = np.concatenate([h for _, h in suffix_dedup._windows(text, 10)])
    sums = hashing.hash_sums(hashing.word_hashes(text))
    at = np.arange(31)
    assert found.tolist() == hashing.part_hashes(sums, at, at + 10).view(np.int64).tolist()


def test_deep_shallow_sort():
    from tidemark.llm.suffix_dedup import common_prefix, deep_shallow

    draw = random.Random(3)
    for _ in range(300):
        strings = [b"a" * draw.choice([0, 20]) + bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 40))) for _ in range(draw.randint(1, 40))]
        order, lcps = deep_shallow(strings)
        assert [strings[i] for i in order] == sorted(strings)
        assert lcps == [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def test_many_equal_windows():
    from tidemark.llm.suffix_dedup import equal_windows

    draw = random.Random(6)
    bodies, lefts = [], []
    for _ in range(60):
        left = bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 12)))
        bodies.append(left + b"ANCHOR" + bytes(draw.choice(b"ab") for _ in range(12)))
        lefts.append(len(left))
    counts = [min(at + 1, len(b) - 13) for b, at in zip(bodies, lefts)]
    seen = Counter((lefts[i] - p, b[p : p + 14]) for i, b in enumerate(bodies) for p in range(counts[i]))
    want = [[seen[lefts[i] - p, b[p : p + 14]] > 1 for p in range(counts[i])] for i, b in enumerate(bodies)]
    for size in (60, 20):
        seen = Counter((lefts[i] - p, b[p : p + 14]) for i, b in enumerate(bodies[:size]) for p in range(counts[i]))
        want = [[seen[lefts[i] - p, b[p : p + 14]] > 1 for p in range(counts[i])] for i, b in enumerate(bodies[:size])]
        got = equal_windows(bodies[:size], lefts[:size], counts[:size], 14)
        assert [[any(a <= p < e for a, e in ranges) for p in range(c)] for ranges, c in zip(got, counts)] == want


# --- licences


def test_licenses(spark):
    from tidemark.llm.licenses import licenses

    rows = [
        ("a/LICENSE", "Intro\nReleased under the MIT License."), ("a/b/x.txt", "some words"), ("a/b/c/LICENSE.md", "Licensed under CC BY-NC 4.0."),
        ("a/b/c/y.txt", None), ("a/b/c/z.txt", "x\nThis work is licensed under the GNU General Public License, version 3."), ("a/w.txt", ""),
        ("top.txt", "nothing here"), (None, "Released under the MIT License."), ("a/w.txt", ""), ("q/COPYING", "no notice"), ("q/r.txt", "long " * 30000),
    ]
    frame = spark.createDataFrame([(*r, "l", 1.0) for r in rows], "path string, text string, license string, score double")
    got = {r.path: (r.license, r.origin, r.from_path) for r in licenses(frame).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own", "a/LICENSE"), "a/b/x.txt": ("MIT", "inherited", "a/LICENSE"),
        "a/b/c/LICENSE.md": ("CC-BY-NC-4.0", "own", "a/b/c/LICENSE.md"), "a/b/c/y.txt": ("CC-BY-NC-4.0", "inherited", "a/b/c/LICENSE.md"),
        "a/b/c/z.txt": ("GPL-3.0", "own", "a/b/c/z.txt"), "a/w.txt": ("MIT", "inherited", "a/LICENSE"), "top.txt": (None, "none", None),
        None: ("MIT", "own", None), "q/COPYING": (None, "none", None), "q/r.txt": (None, "none", None),
    }
    assert licenses(frame.filter("false")).count() == 0


# --- the pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    base = docs.select("doc_id", "text", (docs.doc_id * 0).cast("string").alias("lang"), "source", (docs.doc_id * 0).alias("n_chars"))
    folder = str(tmp_path)
    base.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i, _ in ROWS], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    passage = " ".join(dict(ROWS)[120].split()[:30])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert 4 <= len(pipeline.STAGES) <= 5
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    near = pipeline.drop_near_duplicates(spark, frame, folder)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in brute.near_duplicates(ROWS, 5).items() if i == c)
    cut = pipeline.cut_repeats(spark, frame, folder)
    assert cut.columns == frame.columns
    assert sum(r.n_chars or 0 for r in cut.collect()) < sum(len(t or "") for _, t in ROWS)
    left = {r.doc_id for r in pipeline.drop_leaks(spark, frame, folder).collect()}
    assert 120 not in left and 121 in left
    packed = pipeline.run(spark, folder)
    assert packed.count() > 0 and json.dumps(packed.columns)


def test_pipeline_decides_by_id_and_text(spark, tmp_path):
    import corpus_pipeline as pipeline

    draw = random.Random(21)
    a, b, c, leak = (" ".join(f"{k}{draw.randrange(10**6)}" for _ in range(60)) for k in "abcl")
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [
        (None, a), (None, near(a)), (None, b), (None, leak), (None, None), (None, ""),
        (7, b), (7, c), (7, near(c)), (7, leak), (9, near(c)), (9, leak + " tail"),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = Counter((r.doc_id, r.text) for r in pipeline.drop_leaks(spark, frame, str(tmp_path)).collect())
    assert left == Counter((i, t) for i, t in rows if leak not in (t or ""))
    kept = Counter((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, frame, str(tmp_path)).collect())
    assert sum(kept.values()) == len(kept) == 6
    assert kept[(None, a)] + kept[(None, near(a))] == 1 and kept[(7, c)] + kept[(7, near(c))] == 1
    assert {(None, None), (None, ""), (7, b), (7, leak)} <= set(kept)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == []
    assert "pipeline" in names
