"""Log and script lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import Registry
from queries.frames import load, with_frames
from tidemark.operators import lines as L
from tidemark.operators.rules import DROP_RULES, SAFE_RUN_REWRITES
from tidemark.operators.signatures import SIGNATURES

registry = Registry()

LEVEL = r"(?i)^psql:.+?:(\d+):\s*(NOTICE|ERROR|WARNING|INFO|CONTEXT):\s*(.*)$"
OTHER = r"(?i)^psql:.+?:(\d+):\s*(.*)$"
NOISE = (
    r"(?i)^(BEGIN|COMMIT|ROLLBACK|SET|GRANT|REVOKE|ANALYZE|VACUUM|INSERT \d+ \d+|UPDATE \d+|DELETE \d+|SELECT \d+|COPY \d+|"
    r"COMMENT|DO|(CREATE|ALTER|DROP) [A-Z ]+)$"
)

_CLEAN = f"""{with_frames("log_lines")},
t AS (SELECT doc, line_no, line, CASE
    WHEN regexp_matches(trim(line), '{LEVEL}') THEN '[' || upper(regexp_extract(trim(line), '{LEVEL}', 2)) || '] Line ' || regexp_extract(trim(line), '{LEVEL}', 1)
         || ': ' || regexp_extract(trim(line), '{LEVEL}', 3)
    WHEN regexp_matches(trim(line), '{OTHER}') THEN 'Line ' || regexp_extract(trim(line), '{OTHER}', 1) || ': ' || regexp_extract(trim(line), '{OTHER}', 2)
    END AS clean FROM log_lines),
n AS (SELECT doc, line_no, coalesce(clean, line) AS line FROM t WHERE NOT regexp_matches(coalesce(clean, trim(line)), '{NOISE}'))"""
_SEVERITY = """CASE WHEN contains(lower(line), 'error:') OR contains(line, '❌') OR contains(lower(line), '[error]') THEN 'error'
  WHEN contains(lower(line), 'warning:') OR contains(line, '⚠️') OR contains(lower(line), '[warning]') THEN 'warning' ELSE 'other' END"""


def _log(spark, sf_dir):
    (lines,) = load(spark, sf_dir, "log_lines")
    return L.normalize_log(lines)


@registry.add("normalize_log", f"{_CLEAN}\nSELECT doc, line_no, line FROM n")
def normalize_log(spark, sf_dir):
    return _log(spark, sf_dir)


@registry.add("severity_counts", f"{_CLEAN}\nSELECT {_SEVERITY} AS severity, count(*) AS n_lines FROM n GROUP BY 1")
def severity_counts(spark, sf_dir):
    return L.severity_counts(_log(spark, sf_dir))


@registry.add(
    "severity_summary",
    f"""{_CLEAN},
s AS (SELECT doc, count(*) FILTER ({_SEVERITY} = 'error') AS errors, count(*) FILTER ({_SEVERITY} = 'warning') AS warnings FROM n GROUP BY doc)
SELECT doc, errors, warnings, 'SUMMARY: ' || CASE WHEN errors = 0 THEN 'completed successfully' ELSE 'completed with errors' END
  || '. Errors: ' || errors || ', Warnings: ' || warnings AS summary FROM s""",
)
def severity_summary(spark, sf_dir):
    return L.severity_summary(_log(spark, sf_dir), "doc")


@registry.add(
    "filter_log",
    """WITH docs AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line FROM documents), """
    + with_frames("log_lines").removeprefix("WITH ")
    + """, a AS (SELECT doc, line FROM docs UNION ALL SELECT doc, line FROM log_lines)
SELECT 'text' AS filter, doc, line FROM a WHERE contains(lower(line), 'relation')
UNION ALL SELECT 'Errors', doc, line FROM a WHERE (contains(lower(line), 'error') OR contains(lower(line), 'failed') OR contains(line, '❌'))
  AND contains(lower(line), 'psql') AND NOT contains(line, 'SUMMARY:') AND NOT contains(line, '====')
UNION ALL SELECT 'Success', doc, line FROM a WHERE (contains(lower(line), 'success') OR contains(line, '✅')) AND NOT contains(line, 'SUMMARY:') AND NOT contains(line, '====')
UNION ALL SELECT 'Info', doc, line FROM a WHERE (contains(line, '⚡') OR contains(line, '⌛') OR contains(lower(line), '[info]') OR contains(lower(line), '[cmd]')
  OR contains(lower(line), 'pg_restore')) AND NOT contains(line, 'SUMMARY:') AND NOT contains(line, '====')""",
)
def filter_log(spark, sf_dir):
    documents, log = load(spark, sf_dir, "documents", "log_lines")
    docs = documents.select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("line"))
    lines = docs.unionAll(log.select("doc", "line"))
    parts = [
        L.filter_log(lines, text, kind).select(F.lit(name).alias("filter"), "doc", "line")
        for name, text, kind in (("text", "Relation", "All"), ("Errors", "PSQL", "Errors"), ("Success", "", "Success"), ("Info", "", "Info"))
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def _all_lines(spark, sf_dir):
    script, documents = load(spark, sf_dir, "script_lines", "documents")
    text = documents.select(
        (-F.col("doc_id") - 1).alias("doc"), F.posexplode(F.split("text", "\n")).alias("_pos", "line")
    ).select("doc", (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")
    return script.unionByName(text)


_LINES = f"""{with_frames("script_lines")},
a AS (SELECT doc, line_no, line FROM script_lines UNION ALL
  SELECT -doc_id - 1, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM documents)"""
_DECLARED = r"""(?i)create\s+extension\s+(?:if\s+not\s+exists\s+)?["'']?([a-zA-Z0-9_\-]+)["'']?"""


@registry.add(
    "signature_scan",
    f"""{_LINES},
f AS (SELECT doc, line_no, lower(regexp_extract(line, '{_DECLARED}', 1)) AS name FROM a WHERE regexp_matches(line, '{_DECLARED}')
"""
    + "\n".join(f"UNION ALL SELECT doc, line_no, '{n}' FROM a WHERE regexp_matches(line, '(?i){p}')" for n, p in SIGNATURES.items())
    + ")\nSELECT doc, name, min(line_no) AS first_line FROM f GROUP BY doc, name",
)
def signature_scan(spark, sf_dir):
    return L.signature_scan(_all_lines(spark, sf_dir), "doc")


_ONE_PASS = f"""{_LINES.replace("WITH ", "WITH RECURSIVE ", 1)},
m AS (SELECT doc, line_no, line, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS i,
  regexp_matches(trim(line), '(?i)^COPY .*FROM stdin') AS c, trim(line) = chr(92) || '.' AS ce,
  regexp_matches(trim(line), '(?i)^INSERT INTO ') AS ins, trim(line) LIKE '%;' AS e FROM a),
walk(doc, i, was, now) AS (
  SELECT doc, i, 0, CASE WHEN c THEN 1 WHEN ins AND NOT e THEN 2 ELSE 0 END FROM m WHERE i = 1
  UNION ALL SELECT m.doc, m.i, now, CASE now WHEN 1 THEN CASE WHEN ce THEN 0 ELSE 1 END WHEN 2 THEN CASE WHEN e THEN 0 ELSE 2 END
    ELSE CASE WHEN c THEN 1 WHEN ins AND NOT e THEN 2 ELSE 0 END END FROM walk JOIN m ON m.doc = walk.doc AND m.i = walk.i + 1)
SELECT doc, line_no, line FROM walk JOIN m USING (doc, i) WHERE was = 0 AND NOT c AND NOT ins"""


@registry.add("drop_marked_regions", _ONE_PASS)
def drop_marked_regions(spark, sf_dir):
    return L.drop_data(_all_lines(spark, sf_dir), "doc")


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _reason(rules) -> str:
    cases = " ".join(f"WHEN regexp_matches(c, '{r.pattern}') THEN '{r.reason}'" for r in rules)
    return f"CASE {cases} END"


_REASONS = f"""{with_frames("statements")},
q AS (SELECT id, text, {_squeeze('text')} AS c FROM statements),
f AS (SELECT id, text, c, {_reason(DROP_RULES)} AS reason FROM q)"""


def _records(spark, sf_dir):
    (records,) = load(spark, sf_dir, "statements")
    return records


@registry.add("rule_filter", f"{_REASONS}\nSELECT id, text, reason FROM f")
def rule_filter(spark, sf_dir):
    return L.rule_filter(_records(spark, sf_dir), "text")


_OFF = ("owner", "data")


@registry.add(
    "rule_filter_disabled",
    f"""{with_frames("statements")}, q AS (SELECT id, {_squeeze('text')} AS c FROM statements)
SELECT id, {_reason([r for r in DROP_RULES if r.name not in _OFF])} AS reason FROM q""",
)
def rule_filter_disabled(spark, sf_dir):
    return L.rule_filter(_records(spark, sf_dir), "text", disabled=_OFF).select("id", "reason")


_INLINE = """
w AS (SELECT id, text, c, reason, regexp_replace(text, '(?i)\\bTABLESPACE\\s+(?:\\w+|"[^"]+")', '', 'g') AS w1 FROM f),
w2 AS (SELECT *, CASE WHEN regexp_matches(trim(w1), '(?i)^CREATE TABLE')
  THEN regexp_replace(w1, '(?i)\\bUSING\\s+(?:heap|ao_row|ao_column|column|brin|gin|gist|hash|spgist|btree)\\b', '', 'g') ELSE w1 END AS w2 FROM w)"""
_SAFE = """
w3 AS (SELECT *, CASE
    WHEN regexp_matches(trim(w2), '(?i)^CREATE TABLE') THEN CASE WHEN contains(upper(w2), 'IF NOT EXISTS') THEN w2 ELSE regexp_replace(w2, '(?i)(CREATE\\s+TABLE\\s+)(.*)', '\\1IF NOT EXISTS \\2') END
    WHEN regexp_matches(trim(w2), '(?i)^CREATE (UNIQUE )?INDEX') THEN regexp_replace(w2, '(?i)(CREATE\\s+(?:UNIQUE\\s+)?INDEX\\s+)(.*)', '\\1IF NOT EXISTS \\2')
    WHEN regexp_matches(trim(w2), '(?i)^CREATE SCHEMA') THEN regexp_replace(w2, '(?i)(CREATE\\s+SCHEMA\\s+)(.*)', '\\1IF NOT EXISTS \\2')
    WHEN regexp_matches(trim(w2), '(?i)^ALTER TABLE.*ADD COLUMN') THEN regexp_replace(w2, '(?i)(ADD\\s+COLUMN\\s+)(.*)', '\\1IF NOT EXISTS \\2')
    WHEN regexp_matches(trim(w2), '(?i)^CREATE TRIGGER') THEN 'DROP TRIGGER IF EXISTS ' || regexp_extract(w2, '(?i)TRIGGER\\s+(\\w+)', 1) || ' ON '
         || regexp_extract(w2, '(?i)\\sON\\s+([^\\s;]+)', 1) || ';' || chr(10) || w2
    WHEN regexp_matches(trim(w2), '(?i)^CREATE VIEW') THEN replace(w2, 'CREATE VIEW', 'CREATE OR REPLACE VIEW')
    ELSE w2 END AS w3 FROM w2)"""


@registry.add(
    "rule_rewrite",
    f"{_REASONS},{_INLINE}\nSELECT id, text, w2 AS rewritten, {_squeeze('text')} <> {_squeeze('w2')} AS modified FROM w2",
)
def rule_rewrite(spark, sf_dir):
    return L.rule_rewrite(_records(spark, sf_dir), "text")


@registry.add(
    "rule_rewrite_safe_run",
    f"{_REASONS},{_INLINE},{_SAFE}\nSELECT id, text, w3 AS rewritten, {_squeeze('text')} <> {_squeeze('w3')} AS modified FROM w3",
)
def rule_rewrite_safe_run(spark, sf_dir):
    return L.rule_rewrite(_records(spark, sf_dir), "text", chain=SAFE_RUN_REWRITES)


@registry.add(
    "rule_audit",
    f"""{_REASONS},{_INLINE}
SELECT CASE WHEN reason IS NOT NULL OR {_squeeze('w2')} = '' THEN 'ignored' WHEN {_squeeze('text')} <> {_squeeze('w2')} THEN 'modified' ELSE 'unchanged' END AS action,
  CASE WHEN reason IS NOT NULL THEN reason WHEN {_squeeze('w2')} = '' THEN 'Statement became empty after processing' ELSE '' END AS reason,
  count(*) AS n_records FROM w2 WHERE {_squeeze('text')} <> '' GROUP BY 1, 2""",
)
def rule_audit(spark, sf_dir):
    return L.rule_audit(L.rule_rewrite(L.rule_filter(_records(spark, sf_dir), "text"), "text"))
