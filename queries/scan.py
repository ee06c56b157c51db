"""Keyword scans over every text column of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import Registry
from queries.cascade import EDGES, KEYS as FK_KEYS, fk_tables
from queries.frames import load, with_frames
from tidemark.functions.text import preview
from tidemark.operators import junk as J, scan as S
from tidemark.operators.cascade import cascade_rollup
from tidemark.plans.junk_report import junk_report

registry = Registry()
KEYWORDS = ["test", "123", " token ", "", "license"]
WORDS = ["test", "123", "token", "license"]
KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"], "customer": ["c_custkey"], "part": ["p_partkey"], "pages": []}
COLUMNS = {
    "documents": ["text", "lang", "source"], "conversations": ["role", "text"], "customer": ["c_name", "c_mktsegment"],
    "part": ["p_name", "p_brand", "p_type"], "pages": ["url", "html"],
}
KEY_SQL = {
    "documents": """'{"doc_id":' || doc_id || '}'""",
    "conversations": """'{"conv_id":' || conv_id || ',"turn":' || turn || '}'""",
    "customer": """'{"c_custkey":' || c_custkey || '}'""",
    "part": """'{"p_partkey":' || p_partkey || '}'""",
    "pages": "to_json({'page_id': page_id, 'url': url, 'html': html})::VARCHAR",
}


def _match(column: str, word: str, match: str) -> str:
    if match == "substring":
        return f"contains(lower({column}), '{word}')"
    return f"regexp_matches({column}, '(?i)(^|[^a-zA-Z0-9]){word}([^a-zA-Z0-9]|$)')"


def hits_sql(match: str, tables=("documents", "conversations", "customer", "part")) -> str:
    parts = [
        f"SELECT '{t}' AS table_name, {'true' if not KEYS[t] else 'false'} AS no_key, {KEY_SQL[t]} AS key, {i} AS column_pos, "
        f"'{c}' AS column_name, {j} AS keyword_pos, '{w}' AS keyword, {c} AS content FROM {t} WHERE {_match(c, w, match)}"
        for t in tables for i, c in enumerate(COLUMNS[t]) for j, w in enumerate(WORDS)
    ]
    return "WITH hits AS (\n" + "\nUNION ALL ".join(parts) + ")"


_NAMES = ("documents", "conversations", "customer", "part")


def _tables(spark, sf_dir, names=_NAMES):
    return dict(zip(names, load(spark, sf_dir, *names)))


@registry.add("scan_records_substring", f"{hits_sql('substring')}\nSELECT * FROM hits")
def scan_records_substring(spark, sf_dir):
    return S.scan_records(_tables(spark, sf_dir), KEYS, KEYWORDS)


@registry.add("scan_records_token", f"{hits_sql('token')}\nSELECT * FROM hits")
def scan_records_token(spark, sf_dir):
    return S.scan_records(_tables(spark, sf_dir), KEYS, KEYWORDS, match="token")


@registry.add(
    "scan_records_capped",
    f"""{hits_sql('substring')}
SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY table_name, column_name, keyword ORDER BY key) <= 50""",
)
def scan_records_capped(spark, sf_dir):
    """At most 50 hits per table, column and keyword, as a preview shows them."""
    return S.scan_records(_tables(spark, sf_dir), KEYS, KEYWORDS, cap=50)


@registry.add(
    "scan_no_key",
    f"""{hits_sql('token', ('pages',))}
SELECT table_name, no_key, column_name, keyword, content FROM hits""",
)
def scan_no_key(spark, sf_dir):
    hits = S.scan_records(_tables(spark, sf_dir, ("pages",)), KEYS, KEYWORDS, match="token")
    return hits.select("table_name", "no_key", "column_name", "keyword", "content")


_DEDUPED = """
records AS (SELECT table_name, no_key, key, arg_min(keyword, keyword_pos * 100 + column_pos) AS keyword,
  arg_min(content, keyword_pos * 100 + column_pos) AS content,
  string_agg(DISTINCT column_name, ', ' ORDER BY column_name) AS columns, string_agg(DISTINCT keyword, ', ' ORDER BY keyword) AS keywords
  FROM hits GROUP BY table_name, no_key, key)"""


@registry.add("dedupe_hits", f"{hits_sql('substring')},{_DEDUPED}\nSELECT * FROM records")
def dedupe_hits(spark, sf_dir):
    records = S.dedupe_hits(S.scan_records(_tables(spark, sf_dir), KEYS, KEYWORDS))
    return records.withColumn("columns", F.array_join("columns", ", ")).withColumn("keywords", F.array_join("keywords", ", "))


@registry.add("found_records", f"{hits_sql('token')},{_DEDUPED}\nSELECT * FROM records")
def found_records(spark, sf_dir):
    """Records as the scan itself puts them together, without a shuffle."""
    records = S.found_records(_tables(spark, sf_dir), KEYS, KEYWORDS, "token")
    return records.withColumn("columns", F.array_join("columns", ", ")).withColumn("keywords", F.array_join("keywords", ", "))


# The schema each table is said to stand in; data of fr is not selected, nor is one that no scope names.
SCHEMAS = {"documents": "EN", "conversations": "fr", "customer": "nowhere", "part": "de"}


@registry.add(
    "scan_records_scoped",
    f"""{with_frames("junk_scopes")},
{hits_sql('substring').removeprefix("WITH ")},
place AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{p}')" for t, p in SCHEMAS.items())}) AS p(table_name, in_schema))
SELECT hits.* FROM hits JOIN place USING (table_name) WHERE lower(in_schema) IN (SELECT lower(schema) FROM junk_scopes WHERE include_data)""",
)
def scan_records_scoped(spark, sf_dir):
    """Hits of the tables whose schema is selected for data."""
    (scopes,) = load(spark, sf_dir, "junk_scopes")
    return S.scan_records(_tables(spark, sf_dir), KEYS, KEYWORDS, schemas=SCHEMAS, scopes=scopes)


def _report(spark, sf_dir):
    everything = fk_tables(spark, sf_dir)
    scanned = _tables(spark, sf_dir)
    return junk_report(scanned, {**KEYS, **FK_KEYS}, EDGES, {**everything, **scanned}, KEYWORDS)


# Children of the tables that are scanned and have children: labels of
# documents, orders of customers, lineitems of parts.
_DIRECT = """
direct AS (
  SELECT 'documents' AS table_name, '{"doc_id":' || doc_id || '}' AS key, count(*) AS n FROM labels GROUP BY doc_id
  UNION ALL SELECT 'customer', '{"c_custkey":' || o_custkey || '}', count(*) FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'part', '{"p_partkey":' || l_partkey || '}', count(*) FROM lineitem GROUP BY l_partkey)"""


@registry.add(
    "hits_by_table",
    f"""{hits_sql('substring')},{_DEDUPED},{_DIRECT}
SELECT table_name, count(*) AS n_records, bool_or(n IS NOT NULL) AS has_cascade FROM records LEFT JOIN direct USING (table_name, key) GROUP BY table_name""",
)
def hits_by_table(spark, sf_dir):
    found = _report(spark, sf_dir)
    return S.hits_by_table(found.records, cascade_rollup(found.impact))


@registry.add(
    "junk_report",
    f"""{hits_sql('substring')},{_DEDUPED},{_DIRECT},
flat AS (SELECT *, replace(replace(content, chr(10), ' '), chr(13), '') AS line FROM records)
SELECT table_name, no_key, key, keyword, columns, CASE WHEN length(line) > 160 THEN substring(line, 1, 157) || '…' ELSE line END AS preview,
       coalesce('1t × ' || n || 'r', '— none') AS cascade FROM flat LEFT JOIN direct USING (table_name, key)""",
)
def junk_report_query(spark, sf_dir):
    return _report(spark, sf_dir).report


def _count(word: str) -> str:
    return f"CAST((length(lower(text)) - length(replace(lower(text), '{word}', ''))) // {len(word)} AS BIGINT) AS n_{word}"


@registry.add("keyword_occurrences", f"SELECT doc_id, {', '.join(_count(w) for w in ('the', 'test', 'license', 'es'))} FROM documents")
def keyword_occurrences(spark, sf_dir):
    (documents,) = load(spark, sf_dir, "documents")
    counted = S.keyword_occurrences(documents, "text", ["The", "test", "license", "es"])
    return counted.select("doc_id", F.col("n_The").alias("n_the"), "n_test", "n_license", "n_es")


@registry.add(
    "preview",
    """WITH flat AS (SELECT page_id AS id, replace(replace(html, chr(10), ' '), chr(13), '') AS line FROM pages
  UNION ALL SELECT doc_id, replace(replace(text, chr(10), ' '), chr(13), '') FROM documents)
SELECT id, CASE WHEN length(line) > 160 THEN substring(line, 1, 157) || '…' ELSE line END AS preview FROM flat""",
)
def preview_query(spark, sf_dir):
    pages, documents = load(spark, sf_dir, "pages", "documents")
    texts = pages.select(F.col("page_id").alias("id"), F.col("html").alias("text")).unionAll(documents.select("doc_id", "text"))
    return texts.select("id", preview(F.col("text")).alias("preview"))


JUNK = ["ring", "tmp", "dev", "test", "building"]


def _first(column: str) -> str:
    cases = " ".join(f"WHEN {_match(column, w, 'token')} THEN '{w}'" for w in JUNK)
    return f"CASE {cases} END"


_SCAN = f"""{with_frames("junk_objects", "junk_columns", "junk_scopes")},
o AS (SELECT o.*, {_first('name')} AS kn, {_first('definition')} AS kd, {_first('comment')} AS kc FROM junk_objects o
      WHERE schema = '' OR lower(schema) IN (SELECT lower(schema) FROM junk_scopes WHERE include_structure)),
bad AS (SELECT database, name FROM o WHERE kind = 'Schema' AND (kn IS NOT NULL OR kc IS NOT NULL)),
c AS (SELECT database, schema, table_name, column_name, ordinal, {_first('column_name')} AS kw FROM junk_columns),
fc AS (SELECT database, schema, table_name, column_name, kw FROM c WHERE kw IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY database, schema, table_name ORDER BY ordinal, column_name, kw) = 1),
junk AS (
  SELECT o.database, o.schema, o.kind, o.name, o.parent,
         CASE WHEN kn IS NOT NULL THEN 'Name contains junk: ' || kn
              WHEN kind <> 'Schema' AND kd IS NOT NULL THEN 'Source contains junk: ' || kd
              WHEN kc IS NOT NULL THEN 'Comment contains junk: ' || kc
              WHEN fc.kw IS NOT NULL THEN 'Column ''' || fc.column_name || ''' contains junk: ' || fc.kw END AS reason
  FROM o LEFT JOIN fc ON o.kind = 'Table' AND o.database = fc.database AND o.schema = fc.schema AND o.name = fc.table_name
  WHERE (kind = 'Schema' OR (o.database, o.schema) NOT IN (SELECT database, name FROM bad)) AND lower(o.name) NOT LIKE 'pg!_%' ESCAPE '!')"""


def _junk(spark, sf_dir):
    objects, columns, scopes = load(spark, sf_dir, "junk_objects", "junk_columns", "junk_scopes")
    return J.scan_catalog(objects, columns, JUNK, scopes)


@registry.add("scan_catalog", f"{_SCAN}\nSELECT * FROM junk WHERE reason IS NOT NULL")
def scan_catalog(spark, sf_dir):
    return _junk(spark, sf_dir)


@registry.add(
    "cleanup_plan",
    f"""{_SCAN},
found AS (SELECT * FROM junk WHERE reason IS NOT NULL),
gone AS (SELECT DISTINCT database, name FROM found WHERE kind = 'Schema')
SELECT database, 1 AS phase, name AS schema, 'Schema' AS kind, name, 'DROP SCHEMA IF EXISTS "' || name || '" CASCADE;' AS statement FROM gone
UNION ALL SELECT database, 2, schema, kind, name, CASE kind
    WHEN 'Table' THEN 'DROP TABLE IF EXISTS "' || schema || '"."' || name || '" CASCADE;'
    WHEN 'View' THEN 'DROP VIEW IF EXISTS "' || schema || '"."' || name || '" CASCADE;'
    WHEN 'Role' THEN 'DROP ROLE IF EXISTS "' || name || '";'
    WHEN 'Trigger' THEN 'DROP TRIGGER IF EXISTS "' || name || '" ON "' || schema || '"."' || parent || '" CASCADE;' END
  FROM found WHERE kind <> 'Schema' AND (database, schema) NOT IN (SELECT database, name FROM gone)""",
)
def cleanup_plan(spark, sf_dir):
    return J.cleanup_plan(_junk(spark, sf_dir))
