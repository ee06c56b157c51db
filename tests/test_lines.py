import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lines as L
from tidemark.operators.rules import SAFE_RUN_REWRITES
from tidemark.operators.signatures import SIGNATURES


def frame(spark, *texts):
    rows = [(d, i, line) for d, text in enumerate(texts) for i, line in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "doc int, line_no bigint, line string")


def test_log(spark):
    log = frame(spark, "\n".join([
        "psql:C:/x/y.sql:12: ERROR:  boom", "  psql:a.sql:3: notice:  skipped", "psql:a.sql:4: hint", "INSERT 0 1", "create table",
        "CREATE TABLE foo1", "psql:a.sql:5: WARNING:  low", "pg_restore: error: bad", "plain  ", "",
    ]))
    clean = L.normalize_log(log)
    assert [r.line for r in clean.orderBy("line_no").collect()] == [
        "[ERROR] Line 12: boom", "[NOTICE] Line 3: skipped", "Line 4: hint", "CREATE TABLE foo1", "[WARNING] Line 5: low",
        "pg_restore: error: bad", "plain  ", "",
    ]
    assert {r.severity: r.n_lines for r in L.severity_counts(clean).collect()} == {"error": 2, "warning": 1, "other": 5}
    summary = L.severity_summary(clean, "doc").first()
    assert summary.summary == "SUMMARY: completed with errors. Errors: 2, Warnings: 1"


def test_filter(spark):
    log = frame(spark, "❌ SUMMARY: failed\n❌ x\nall Failed\n✅ ok\n[cmd] run pg_restore\nnothing\n==== success")
    kept = lambda **o: [r.line for r in L.filter_log(log, **o).orderBy("line_no").collect()]
    assert kept(kind="Errors") == ["❌ x", "all Failed"]
    assert kept(kind="Success") == ["✅ ok"]
    assert kept(kind="Info") == ["[cmd] run pg_restore"]
    assert kept(text="FAILED") == ["❌ SUMMARY: failed", "all Failed"] and len(kept()) == 7
    with pytest.raises(ValueError):
        L.filter_log(log, kind="Other")


SAMPLES = [
    "select UUID_GENERATE_V4()", "pgp_sym_decrypt(x)", "pgp_pub_encrypt", "my crypt", "ST_Area(g)", "crosstab2", "crosstab(", "using\tbloom",
    "cron.schedule('x')", "jwt.sign", "LANGUAGE plv8", "x plv8_ y", "ip6r", "vectors", "vector", "st_", "ean13", "Create Extension if not exists 'My-Ext'",
    "create extension hstore;", "uuid_generate_v9", "time_bucket_gapfill", "add_months", "digestive", "lo_oid",
]


def test_signatures_agree_with_every_pattern_alone(spark):
    lines = frame(spark, *SAMPLES)
    got = {(r.doc, r.name) for r in L.signature_scan(lines, "doc").collect()}
    want = set()
    for name, pattern in SIGNATURES.items():
        want |= {(r.doc, name) for r in lines.where(F.col("line").rlike("(?i)" + pattern)).collect()}
    assert got - want == {(17, "my-ext")} and want <= got
    odd = {"bar": r"fo+o|\bbar\b", "opt": r"\bcolou?r\b", "grp": r"\b(a|b)x\b"}
    assert L.leading_words(odd["bar"]) == [] and L.leading_words(odd["opt"]) == ["colo"] and L.leading_words(odd["grp"]) == []
    text = frame(spark, "xxfooo\ncolor\ncolour\nbx\nrebar bar")
    found = {(r.name, r.first_line) for r in L.signature_scan(text, "doc", odd).collect()}
    assert found == {("bar", 1), ("opt", 2), ("grp", 4)}
    assert {r.name for r in L.signature_scan(text, "doc", odd, max_lines=2).collect()} == {"bar", "opt"}


def dropped_by_hand(lines):
    kept, inside = [], False
    for line in lines:
        starts, ends = line.startswith("S"), line.endswith("E")
        if not inside and not starts:
            kept.append(line)
        inside = (inside or starts) and not ends
    return kept


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_regions_in_chunks(spark, chunk):
    rng = random.Random(chunk)
    texts = [[rng.choice(["S", "SE", "xE", "x", "y", "z"]) + "" for _ in range(40)] for _ in range(5)] + [["x", "S"] + ["x"] * 20, ["xE", "x"]]
    lines = frame(spark, *["\n".join(t) for t in texts])
    out = L.drop_marked_regions(lines, "doc", F.col("line").startswith("S"), F.col("line").endswith("E"), chunk_lines=chunk)
    got = {}
    for r in out.orderBy("doc", "line_no").collect():
        got.setdefault(r.doc, []).append(r.line)
    assert {d: got.get(d, []) for d in range(len(texts))} == {d: dropped_by_hand(t) for d, t in enumerate(texts)}


def test_drop_data(spark):
    text = "a\nCOPY t (id) FROM stdin;\n1\nINSERT INTO x\n\\.\nb\nINSERT INTO t VALUES\n(1),\n(2);\nc\ninsert into t values (1);\nd\nCOPY u FROM stdin;\n9"
    assert [r.line for r in L.drop_data(frame(spark, text), "doc").orderBy("line_no").collect()] == ["a", "b", "c", "d"]


def records(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_drop_rules(spark):
    texts = {
        "BEGIN;": "Transaction statement removed", ";; commit work ;": "Transaction statement removed", "BEGIN ISOLATION": None,
        "insert into t values (1)": "Data/Insert statement removed", "ALTER TABLE x\n OWNER  TO y": "OWNER TO statement removed",
        "GRANT x": "Privilege statement removed", "GRANTED": None, "COMMENT ON x": "Comment statement removed",
        "drop publication p": "Publication statement removed", "ALTER SUBSCRIPTION p": "Subscription statement removed",
        "SECURITY LABEL x": "Security Label statement removed", "CREATE SCHEMA s": "Schema statement removed",
        "ALTER TABLE t SET TABLESPACE x": "Tablespace alter statement removed", "SELECT 1": None,
    }
    got = {r.text: r.reason for r in L.rule_filter(records(spark, *texts), "text").collect()}
    assert got == texts


def test_rewrites(spark):
    cases = {
        "CREATE TABLE t (a int) USING heap TABLESPACE \"x y\";": "CREATE TABLE IF NOT EXISTS t (a int)  ;",
        "create table if not exists t;": "create table if not exists t;",
        "CREATE UNIQUE INDEX i ON t USING btree (a);": "CREATE UNIQUE INDEX IF NOT EXISTS i ON t USING btree (a);",
        "ALTER TABLE t DROP COLUMN c;": "ALTER TABLE t DROP COLUMN IF EXISTS c;",
        "ALTER TABLE t ADD COLUMN c int;": "ALTER TABLE t ADD COLUMN IF NOT EXISTS c int;",
        "ALTER TABLE t DROP CONSTRAINT c;": "ALTER TABLE t DROP CONSTRAINT IF EXISTS c;",
        "CREATE TRIGGER g BEFORE INSERT ON s.t;": "DROP TRIGGER IF EXISTS g ON s.t;\nCREATE TRIGGER g BEFORE INSERT ON s.t;",
        "CREATE FUNCTION f()": "CREATE OR REPLACE FUNCTION f()", "CREATE PROCEDURE f()": "CREATE OR REPLACE PROCEDURE f()",
        "CREATE MATERIALIZED VIEW m AS x": "DROP MATERIALIZED VIEW IF EXISTS m;\nCREATE MATERIALIZED VIEW m AS x",
        "CREATE POLICY p ON t USING (true)": "DROP POLICY IF EXISTS p ON t;\nCREATE POLICY p ON t USING (true)",
        "CREATE SEQUENCE s": "CREATE SEQUENCE IF NOT EXISTS s", "CREATE EXTENSION e": "CREATE EXTENSION IF NOT EXISTS e",
        "CREATE SCHEMA s": "CREATE SCHEMA IF NOT EXISTS s", "SELECT   1": "SELECT   1",
    }
    got = {r.text: (r.rewritten, r.modified) for r in L.rule_rewrite(records(spark, *cases), "text", chain=SAFE_RUN_REWRITES).collect()}
    assert got == {k: (v, " ".join(k.split()) != " ".join(v.split())) for k, v in cases.items()}
    guarded = records(spark, 'CREATE TYPE s."Mood" AS ENUM (\'a\', \'b\');', "CREATE DOMAIN d AS int;", 'CREATE ROLE "app" LOGIN;')
    texts = [r.rewritten for r in L.rule_rewrite(guarded, "text", chain=SAFE_RUN_REWRITES).orderBy("id").collect()]
    assert "t.typname = 'Mood'" in texts[0] and "CREATE TYPE s.\"Mood\" AS ENUM ('a', 'b');" in texts[0] and texts[0].endswith("END $$;")
    assert "t.typname = 'd'" in texts[1] and "CREATE DOMAIN d AS int;" in texts[1]
    assert "rolname = 'app'" in texts[2] and 'CREATE ROLE "app" LOGIN;' in texts[2]


def test_audit(spark):
    frame = records(spark, "BEGIN;", "SELECT 1", "SELECT 2", "CREATE TABLE t USING heap", "TABLESPACE x", "  ")
    audit = L.rule_audit(L.rule_rewrite(L.rule_filter(frame, "text"), "text"))
    assert {(r.action, r.reason): r.n_records for r in audit.collect()} == {
        ("ignored", "Transaction statement removed"): 1, ("unchanged", ""): 2, ("modified", ""): 1,
        ("ignored", "Statement became empty after processing"): 1,
    }
