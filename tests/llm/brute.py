"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def near_duplicates(rows, words=2, percent=80):
    """{id: (set size, smallest linked id)}"""
    sets = {}
    for i, t in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered) if x]
        sets[i] = frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if percent * len(sets[j]) > 100 * len(sets[i]):
                break
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def remove_repeats(rows, length):
    """[(id, bytes, removed bytes, spans, sha256 of the rest)]"""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        rest = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def _words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def _bag(words, size):
    if len(words) < size:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(size))))


def similarity(one, two, size):
    """Jaccard similarity of the sets of word shingles; two without words are alike."""
    a, b = set(_bag(_words(one), size)), set(_bag(_words(two), size))
    return len(a & b) / len(a | b) if a | b else 1.0


def contaminated(rows, items, words=5, percent=80):
    """[(id, item, similarity, start, words of the item)], the best window of each."""
    out = []
    for item_id, item_text in items:
        item = _words(item_text)
        if not item:
            continue
        size = min(words, len(item))
        want = Counter(zip(*(item[k:] for k in range(size))))
        for doc_id, text in rows:
            doc, best = _words(text), None
            if len(doc) < size:
                continue
            shingles = list(zip(*(doc[k:] for k in range(size))))
            length = min(len(shingles), len(item) - size + 1)
            for start in range(len(shingles) - length + 1):
                if shingles[start] not in want and start < len(shingles) - length:
                    continue  # moving on to a hit loses nothing
                window = Counter(shingles[start : start + length])
                common = sum((window & want).values())
                whole = sum((window | want).values())
                if 100 * common >= percent * whole and (best is None or common / whole > best[0]):
                    best = common / whole, start
            if best:
                out.append((doc_id, item_id, round(best[0], 9), best[1], len(item)))
    return out
