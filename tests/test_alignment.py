import random
import time

import numpy as np
import pytest

from tidemark.operators import alignment as A


def longest(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def check(new, old):
    """Every line once, in order, kinds as defined; returns the number of same lines."""
    rows = list(A.aligned("\n".join(new), "\n".join(old)))
    assert [s for s, _, _ in rows if s] == list(range(1, len(new) + 1))
    assert [t for _, t, _ in rows if t] == list(range(1, len(old) + 1))
    for s, t, kind in rows:
        assert kind == ("added" if t is None else "removed" if s is None else "same" if A._compared(new[s - 1]) == A._compared(old[t - 1]) else "changed")
    return sum(kind == "same" for _, _, kind in rows)


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_like_brute_force(cells, monkeypatch):
    monkeypatch.setattr(A, "TABLE_CELLS", cells)
    rng = random.Random(5)
    for _ in range(300):
        letters = [f"w{rng.randrange(3)} {c}" for c in "abcdefghijkl"]
        new, old = rng.sample(letters, rng.randrange(1, 9)), rng.sample(letters, rng.randrange(1, 9))
        assert check(new, old) == longest(new, old)
        x, y = (np.array([rng.randrange(3) for _ in range(rng.randrange(12))]) for _ in range(2))
        pairs = list(A._common(x, y))
        assert len(pairs) == longest(x.tolist(), y.tolist()) and pairs == sorted(pairs)
        assert all(x[i] == y[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        repeated = lambda: [rng.choice(["a", "b", "", " a,"]) for _ in range(rng.randrange(1, 9))]
        new, old = repeated(), repeated()
        assert check(new, old) <= longest(*([A._compared(v) for v in lines] for lines in (new, old)))


def test_moved_and_changed_lines():
    rows = list(A.aligned("id int,\nname text\nnote text\nage int", "note text,\nid  int\nname varchar\nage int "))
    assert rows == [(1, None, "added"), (2, None, "added"), (3, 1, "same"), (None, 2, "removed"), (None, 3, "removed"), (4, 4, "same")]
    rows = list(A.aligned("id int,\nname text\nage int", "x y\nid  int\nname varchar\nage int "))
    assert rows == [(None, 1, "removed"), (1, 2, "changed"), (2, 3, "changed"), (3, 4, "same")]
    assert list(A.aligned(None, "a\n")) == [(None, 1, "removed"), (None, 2, "removed")]
    assert list(A.aligned(None, None)) == [] and list(A.aligned("", "")) == [(1, 1, "same")]


def test_a_long_text():
    rng = random.Random(1)
    lines = [f"line {i}" if i % 3 else "end;" for i in range(100_000)]
    other = [v for v in lines if rng.random() > 0.01]
    for _ in range(500):
        other.insert(rng.randrange(len(other)), rng.choice(["end;", "new"]))
    start = time.time()
    same = check(other, lines)
    assert same >= 98_000 and time.time() - start < 60


def test_over_documents(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, body string")
    src, tgt = frame([("a", "x\ny"), ("b", "z"), ("n", None)]), frame([("a", "y\nx"), ("c", "q"), ("n", "r")])
    rows = {(r.id, r.source_line, r.target_line, r.kind) for r in A.line_alignment(src, tgt, "id", "body").collect()}
    assert rows - {("a", 1, 2, "same"), ("a", 2, None, "added"), ("a", None, 1, "removed"), ("a", 1, None, "added"), ("a", 2, 1, "same"), ("a", None, 2, "removed")} == {
        ("b", 1, None, "added"), ("c", None, 1, "removed"), ("n", None, 1, "removed"),
    }
    assert len([r for r in rows if r[0] == "a"]) == 3
    assert A.line_alignment(src.where("false"), tgt.where("false"), "id", "body").count() == 0
