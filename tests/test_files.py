import pytest
from pyspark.sql import functions as F

from tidemark.operators.risk import change_risk
from tidemark.operators.edges import FkEdge
from tidemark.sources import files as X, snapshots as P
from tidemark.streaming import logs as T


def test_lines_of_split_files(spark, tmp_path):
    texts = {"a.log": ["line %d %s" % (i, "x" * (i % 37)) for i in range(900)], "b.log": ["", "only", ""], "c d+e.log": ["é"] * 50}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = X.read_lines(spark, str(tmp_path))
        got = {}
        for r in lines.orderBy("file", "line_no").collect():
            got.setdefault(r.file, []).append((r.line_no, r.line))
        assert list(got.values()) == [list(enumerate(t, 1)) for t in texts.values()]
        assert X.read_lines(spark, str(tmp_path), max_lines=2).count() == 6
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_config_tree(spark, tmp_path):
    (tmp_path / "sub dir" / "deep").mkdir(parents=True)
    (tmp_path / "a.json").write_text('{"a":\n1}')
    (tmp_path / "sub dir" / "deep" / "b+1.env").write_text("A=1\nB=2")
    (tmp_path / "sub dir" / "c.txt").write_text("no")
    got = {r.path: r.content for r in X.read_config_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.json": '{"a":\n1}', "sub dir/deep/b+1.env": "A=1\nB=2"}


def test_snapshot_round_trip(spark, tmp_path):
    tables = {"t": spark.range(100).withColumn("v", F.col("id") * 2), "u": spark.range(0)}
    manifest = P.export_snapshot(tables, str(tmp_path / "out"))
    assert {r.table_name: r.n_rows for r in manifest.collect()} == {"t": 100, "u": 0}
    back = P.read_snapshot(spark, str(tmp_path / "out"), ["t"], where="id < 10")["t"]
    assert back.count() == 10
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(id,10)" in plan


def test_stream_picks_up_new_files_once(spark, tmp_path):
    source, out, state, counts, count_state = [str(tmp_path / n) for n in ("in", "out", "state", "counts", "count_state")]
    (tmp_path / "in").mkdir()
    add = lambda name, text: (tmp_path / "in" / name).write_text(text)

    def run():
        T.write_available(T.log_stream(spark, source), out, state)
        T.count_available(T.severity_stream(T.log_stream(spark, source)), counts, count_state)

    add("1.log", "psql:a:1: ERROR: x\nCOMMIT\nok\n")
    run()
    run()
    add("2.log", "warning: y\nerror: z\n")
    run()
    lines = sorted(r.line for r in spark.read.parquet(out).collect())
    assert lines == ["[ERROR] Line 1: x", "error: z", "ok", "warning: y"]
    assert {r.severity: r.n_lines for r in T.latest_counts(spark, counts).collect()} == {"error": 2, "other": 1, "warning": 1}


def test_change_risk(spark):
    users = lambda rows: spark.createDataFrame(rows, "id int, password string, note string")
    posts = lambda rows: spark.createDataFrame(rows, "id int, user_id int")
    src = {"users": users([(1, "pw", None), (4, "x", "n")]), "posts": posts([(1, 1), (2, 3), (3, None)])}
    tgt = {"users": users([(1, "", "n"), (2, None, None), (3, None, "a")]), "posts": posts([(1, 1)])}
    keys = {"users": ["id"], "posts": ["id"]}
    rows = change_risk(src, tgt, keys, [FkEdge("posts", ("user_id",), "users", ("id",))], max_share=0.5).collect()
    got = {(r.table_name, r.check, r.detail): (r.n_rows, r.flagged) for r in rows}
    assert got[("users", "bulk_delete", "")] == (2, True) and got[("users", "bulk_update", "")] == (1, False)
    assert got[("users", "sensitive_value", "password")] == (2, True)
    assert got[("users", "unusual_null", "note")] == (1, True)
    assert got[("posts", "orphan", "user_id -> users")] == (1, True)


def test_exports_are_read_by_their_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    tables = {"a": spark.range(10), "b": spark.sql("SELECT 1 AS x, CAST(NULL AS STRING) AS y"), "none": spark.range(0)}
    assert {r.table_name: r.n_rows for r in P.export_snapshot(tables, path).collect()} == {"a": 10, "b": 1, "none": 0}
    back = P.read_export(spark, path)
    assert {t: sorted(df.collect()) for t, df in back.items()} == {t: sorted(df.collect()) for t, df in tables.items()}
    assert all(back[t].dtypes == df.dtypes for t, df in tables.items())
    # Rows that came later, and an export that was broken off.
    spark.range(1).write.mode("append").parquet(f"{path}/a")
    with pytest.raises(ValueError, match="a has 11 rows, not 10"):
        P.read_export(spark, path)
    broken = spark.range(5).select(F.raise_error(F.lit("stopped")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="stopped"):
        P.export_snapshot({"a": spark.range(3), "b": broken}, path, "overwrite")
    with pytest.raises(Exception, match="(?i)path.*not.*exist"):
        P.read_export(spark, path)
    P.export_snapshot({"a": spark.range(3)}, path, "overwrite")
    assert set(P.read_export(spark, path)) == {"a"}
