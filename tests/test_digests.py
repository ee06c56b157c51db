import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import diff as D, digests as G, sync as S

SCHEMA = "k int, j string, v string, w double, a array<int>, m map<string,int>, t timestamp"


def rows(seed, n):
    pick = random.Random(seed).choice
    return [
        (
            pick([1, 2, 3, None]), pick(["a", None, "b"]), pick(["x", "", None]), pick([0.0, -0.0, float("nan"), 1.5]),
            pick([[1, None], [None, 1], [1], [], None]), pick([{"p": 1, "q": 2}, {"q": 2, "p": 1}, {}, None]), None,
        )
        for _ in range(n)
    ]


def frame(spark, values):
    return spark.createDataFrame(values, SCHEMA).withColumn("t", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, coalesce(k, 0))"))


def bag(df):
    flat = df.select("op", "k", "j", "occurrence", F.to_json("source").alias("s"), F.to_json("target").alias("t"), F.array_join("changed_columns", ","))
    return sorted(map(repr, flat.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_are_the_row_diff_without_equal_rows(spark, seed):
    common = rows(seed, 60)
    src, tgt = frame(spark, common + rows(seed + 10, 15)), frame(spark, common[5:] + rows(seed + 20, 5))
    for options in (D.CompareOptions(), D.CompareOptions(ignore=["W", "a"], where="k > 1")):
        want = bag(D.row_diff(src, tgt, ["k", "j"], options).where("op <> 'S'"))
        assert want and bag(D.row_changes(src, tgt, ["k", "j"], options)) == want
        assert bag(D.row_changes(src, tgt, ["k", "j"], options, by_ranges=True)) == want


def test_equal_sides_differ_nowhere(spark):
    src = frame(spark, rows(3, 80))
    shuffled = frame(spark, sorted(rows(3, 80), key=lambda r: repr(r)[::-1]))
    assert G.differing_ranges(src, shuffled, ["k", "j"], src.columns[2:-2]).count() == 0
    assert S.verify_sync({"t": src}, {"t": shuffled}, {"t": ["k", "j"]}).first().passed


def test_every_kind_of_difference_is_seen(spark):
    one = lambda *v: spark.createDataFrame([v], "k int, x string, y string, a array<int>")
    base = one(1, None, "q", [1, None])
    for other in (one(1, "q", None, [1, None]), one(1, None, "q", [None, 1]), one(1, None, "q", [1]), one(1, "", "q", [1, None]), one(None, None, "q", [1, None])):
        assert D.row_changes(base, other, ["k"]).count() in (1, 2)
    twice = base.unionAll(base)
    assert [r.op for r in D.row_changes(twice, base, ["k"]).collect()] == ["I"]
    empty = base.where("false")
    assert D.row_changes(empty, empty, ["k"]).count() == 0
    assert [r.op for r in D.row_changes(empty, twice, ["k"]).collect()] == ["D", "D"]


def test_differences_that_do_not_count(spark):
    stamp = lambda text: spark.sql(f"SELECT 1 AS k, timestamp'{text}' AS t")
    near, far = stamp("2024-01-01 00:00:00.001"), stamp("2024-01-01 00:00:00.003")
    assert G.differing_keys(near, far, ["k"], ["t"]).count() == 1
    assert D.row_changes(near, stamp("2024-01-01 00:00:00"), ["k"]).count() == 0
    assert D.row_changes(near, far, ["k"]).first().changed_columns == ["t"]
    # Keys of other types cannot be hashed together.
    wide = far.select(F.col("k").cast("bigint").alias("k"), "t")
    assert D.row_changes(near, wide, ["k"], by_ranges=True).first().op == "U"


def test_unchanged_rows_do_not_move(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 500 == 0, 0.0).otherwise(F.col("o_totalprice")))
    keys = G.differing_keys(orders, changed, ["o_orderkey"], orders.columns[1:])._jdf.queryExecution().executedPlan().toString()
    assert keys.count("Exchange hashpartitioning") == 1 and "Join" not in keys and "Sort" not in keys
    plan = D.row_changes(orders, changed, ["o_orderkey"], D.CompareOptions(unique_keys=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") >= 2 and "Window" not in plan
    # The written keys are few, so the rows of both sides are filtered where they are read.
    assert plan.count("BroadcastHashJoin") >= 2


def test_numbers_of_keys_move_instead_of_keys(spark, monkeypatch):
    rows = [(k, "k" * 50, v) for k in range(20) for v in range(k % 4 + 1)] + [(None, None, 1), (None, "x", None)]
    other = [(k, j, v + 1 if k == 7 else v) for k, j, v in rows if k != 3] + [(5, "k" * 50, 0), (99, None, 0), (None, "x", None)]
    src, tgt = (spark.createDataFrame(r, "k int, j string, v int") for r in (rows, other))
    want = bag(D.row_diff(src, tgt, ["k", "j"]).where("op <> 'S'"))
    found = G.differing_numbers(src, tgt, ["k", "j"], ["v"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanged) == 1 and "hashpartitioning(number" in exchanged[0] and " j#" not in exchanged[0]
    assert found.columns == ["number", "source_rows", "target_rows"]
    assert bag(D.row_changes(src, tgt, ["k", "j"])) == want
    # Sums that are too large, and keys that share a number, are compared as well.
    monkeypatch.setattr(G, "_WIDE", 63)
    assert bag(D.row_changes(src, tgt, ["k", "j"])) == want
    shared = lambda keys: F.pmod(F.xxhash64(*keys), F.lit(3))
    monkeypatch.setattr(G, "key_number", shared)
    monkeypatch.setattr(D, "key_number", shared)
    assert bag(D.row_changes(src, tgt, ["k", "j"])) == want
