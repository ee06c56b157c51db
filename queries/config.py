"""Configuration drift over files derived from events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import Registry
from queries.frames import load, with_frames
from tidemark.operators import config as C, risk as R

registry = Registry()

SECRET = "(password|secret|token|key)"


def _tree(frame: str, name: str) -> str:
    """All nodes of the JSON files of a frame; path as dotted text."""
    return f"""{name} AS (SELECT f.path AS file, replace(substring(j.fullkey, 3), '"', '') AS path, j.key, j.type,
  CASE j.type WHEN 'VARCHAR' THEN j.atom ->> '$' WHEN 'NULL' THEN 'null' ELSE CAST(j.value AS VARCHAR) END AS value,
  j.id, j.parent FROM {frame} f, json_tree(f.content) j)"""


_KIND = """CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object'
 WHEN 'ARRAY' THEN 'array' ELSE 'number' END"""


@registry.add(
    "flatten_json",
    f"""{with_frames("json_files")},
{_tree("json_files", "n")}
SELECT file, path, {_KIND} AS type, value FROM n WHERE type <> 'OBJECT' AND path NOT LIKE '%[%'""",
)
def flatten_json(spark, sf_dir):
    (files,) = load(spark, sf_dir, "json_files")
    return C.flatten_json(files.withColumnRenamed("path", "file"), "file", "content")


# The differences that the two frames are built to have, one by one.
_CHANGE_CTES = f"""
e AS (SELECT lower('host_' || user_id || '/' || event_id || '.json') AS file, event_type AS t, user_id AS u, event_id AS i
      FROM events WHERE event_type <> 'signup' OR (user_id < 100 AND user_id >= 50)),
c AS (
  SELECT file, 'app.api_key' AS path, 'value' AS change, 'k0' AS old_value, 'k' || u AS new_value FROM e WHERE t = 'click' AND u <> 0
  UNION ALL SELECT file, 'app.limits', 'value', '7', '{{"max":' || i || ',"tags":["a","error"]}}' FROM e WHERE t = 'error'
  UNION ALL SELECT file, 'app.limits.tags', 'array', '["b","click"]', '["a","click"]' FROM e WHERE t = 'click'
  UNION ALL SELECT file, 'debug', 'value', 'false', 'true' FROM e WHERE t = 'error'
  UNION ALL SELECT file, 'debug', 'value', 'on', 'false' FROM e WHERE t = 'purchase'
  UNION ALL SELECT file, 'none', 'value', '0', 'null' FROM e WHERE t = 'view'
  UNION ALL SELECT file, 'extra', 'added', NULL, '{{"password":"x","z":[]}}' FROM e WHERE t = 'view'
  UNION ALL SELECT file, 'was', 'removed', '{{"a":1}}', NULL FROM e WHERE t = 'click')"""


@registry.add("json_diff", f"{with_frames('json_files', 'old_json_files')},{_CHANGE_CTES}\nSELECT * FROM c")
def json_diff(spark, sf_dir):
    new, old = load(spark, sf_dir, "json_files", "old_json_files")
    named = lambda df: df.select(F.lower("path").alias("file"), "content")
    return C.json_diff(named(old), named(new), "file", "content")


@registry.add(
    "redact_json",
    f"""{with_frames("json_files")},
{_tree("json_files", "n")}
SELECT file, replace(replace(path, '[', '.'), ']', '') AS path, {_KIND} AS type,
  CASE WHEN type = 'VARCHAR' AND regexp_matches(lower(key), '{SECRET}') AND NOT regexp_matches(lower(regexp_replace(path, '[^.]*$', '')), '{SECRET}')
       THEN '' ELSE value END AS value
FROM n WHERE type NOT IN ('OBJECT', 'ARRAY') OR CAST(value AS VARCHAR) IN ('{{}}', '[]')""",
)
def redact_json(spark, sf_dir):
    (files,) = load(spark, sf_dir, "json_files")
    return C.redact_json(files.withColumnRenamed("path", "file"), "file", "content")


def env_lines_sql(frame: str, name: str) -> str:
    return f"""{name} AS (SELECT path, unnest(string_split(content, chr(10))) AS line,
  generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM {frame})"""


def _vars(lines: str, name: str) -> str:
    return f"""{name} AS (SELECT path, line_no, trim(substring(trim(line), 1, strpos(trim(line), '=') - 1)) AS key,
  trim(substring(trim(line), strpos(trim(line), '=') + 1)) AS value FROM {lines} WHERE strpos(trim(line), '=') > 1 AND NOT starts_with(trim(line), '#'))"""


_ENV_CTES = f"""
{env_lines_sql("env_files", "nl")}, {env_lines_sql("old_env_files", "ol")}, {_vars("nl", "nv")}, {_vars("ol", "ov")}"""
_ENV = with_frames("env_files", "old_env_files") + "," + _ENV_CTES


def _lines(files):
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))


@registry.add("parse_env", f"{_ENV}\nSELECT path, line_no, key, value FROM nv")
def parse_env(spark, sf_dir):
    (files,) = load(spark, sf_dir, "env_files")
    return C.parse_env(_lines(files), "path")


_ENV_DIFF_CTES = f"""
nd AS (SELECT path, key, arg_max(value, line_no) AS v FROM nv GROUP BY ALL), od AS (SELECT path, key, arg_max(value, line_no) AS v FROM ov GROUP BY ALL),
ed AS (SELECT path, key, CASE WHEN od.v IS NULL THEN 'added' WHEN nd.v IS NULL THEN 'removed' ELSE 'changed' END AS change,
       od.v AS old_value, nd.v AS new_value FROM od FULL OUTER JOIN nd USING (path, key) WHERE od.v IS DISTINCT FROM nd.v)"""


@registry.add("env_diff", f"{_ENV},{_ENV_DIFF_CTES}\nSELECT * FROM ed")
def env_diff(spark, sf_dir):
    new, old = load(spark, sf_dir, "env_files", "old_env_files")
    return C.env_diff(C.parse_env(_lines(old), "path"), C.parse_env(_lines(new), "path"), "path")


@registry.add(
    "redact_env",
    f"""{_ENV}
SELECT l.path, l.line_no, CASE WHEN trim(l.line) = '' OR starts_with(trim(l.line), '#') THEN l.line
  WHEN regexp_matches(lower(v.key), '{SECRET}') THEN v.key || '=' ELSE trim(l.line) END AS line
FROM nl l LEFT JOIN nv v USING (path, line_no)""",
)
def redact_env(spark, sf_dir):
    (files,) = load(spark, sf_dir, "env_files")
    return C.redact_env(_lines(files), "path")


_FILES = with_frames("config_files", "old_config_files")
_TREE_DIFF = """SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'common' END AS file_status
FROM config_files n FULL OUTER JOIN old_config_files o ON lower(n.path) = lower(o.path)"""


@registry.add("tree_diff", f"{_FILES}\n{_TREE_DIFF}")
def tree_diff(spark, sf_dir):
    new, old = load(spark, sf_dir, "config_files", "old_config_files")
    return C.tree_diff(old, new)


def _shown(value: str) -> str:
    """A value as the report shows it: secrets blank, inside subtrees too."""
    return f"""CASE WHEN {value} IS NULL THEN NULL WHEN regexp_matches(lower(path), '{SECRET}') THEN ''
  ELSE replace({value}, '"password":"x"', '"password":""') END"""


_REPORT = f"""{_FILES},{_CHANGE_CTES},{_ENV_CTES},{_ENV_DIFF_CTES},
one AS (SELECT * FROM ({_TREE_DIFF}) WHERE file_status <> 'common'),
js AS (SELECT file AS path, path AS item, change, {_shown('old_value')} AS old_value, {_shown('new_value')} AS new_value FROM c),
es AS (SELECT path, key AS item, change, CASE WHEN regexp_matches(lower(key), '{SECRET}') AND old_value IS NOT NULL THEN '' ELSE old_value END AS old_value,
         CASE WHEN regexp_matches(lower(key), '{SECRET}') AND new_value IS NOT NULL THEN '' ELSE new_value END AS new_value
       FROM ed WHERE path IN (SELECT path FROM env_files) AND path IN (SELECT path FROM old_env_files)),
report AS (
  SELECT path, file_status, NULL AS item, 'file' AS change, NULL AS old_value, NULL AS new_value, CASE file_status WHEN 'added' THEN '+ ' ELSE '- ' END || path AS line FROM one
  UNION ALL SELECT path, 'common', item, change, old_value, new_value, CASE change WHEN 'added' THEN '+ Added Property: ' || item || ' = ' || new_value
     WHEN 'removed' THEN '- Removed Property: ' || item || ' = ' || old_value
     ELSE '~ Changed ' || CASE change WHEN 'array' THEN 'Array' ELSE 'Value' END || ': ' || item || ' from ''' || old_value || ''' to ''' || new_value || '''' END FROM js
  UNION ALL SELECT path, 'common', item, change, old_value, new_value, CASE change WHEN 'added' THEN '+ Added Variable: ' || item || ' = ' || new_value
     WHEN 'removed' THEN '- Removed Variable: ' || item || ' = ' || old_value ELSE '~ Changed Variable: ' || item || ' from ''' || old_value || ''' to ''' || new_value || '''' END FROM es)"""

@registry.add("drift_report", f"{_REPORT}\nSELECT * FROM report")
def drift_report(spark, sf_dir):
    new, old = load(spark, sf_dir, "config_files", "old_config_files")
    return C.drift_report(old, new)


# Three kinds of files go bad: new ones of error events are cut short, old ones of
# clicks say a name twice, and new ones of signups, added or not, are no JSON at all.
_BAD_SQL = f"""{_FILES}, bad AS (
  SELECT lower('host_' || user_id || '/' || event_id || '.json') AS file, event_type AS t, event_type = 'signup' AND user_id < 50 AS is_new FROM events
  WHERE event_type IN ('error', 'click') OR (event_type = 'signup' AND user_id < 100)),"""


@registry.add(
    "drift_report_bad_files",
    f"""{_REPORT.replace(_FILES + ",", _BAD_SQL, 1)}
SELECT * FROM report WHERE lower(path) NOT IN (SELECT file FROM bad WHERE t <> 'signup')
UNION ALL SELECT file, CASE WHEN is_new THEN 'added' ELSE 'common' END, NULL, 'error',
  CASE t WHEN 'click' THEN 'a name is repeated, or text follows the end' END, CASE WHEN t <> 'click' THEN 'no readable JSON' END,
  '! Not read, ' || CASE t WHEN 'click' THEN 'old: a name is repeated, or text follows the end' ELSE 'new: no readable JSON' END FROM bad""",
)
def drift_report_bad_files(spark, sf_dir):
    new, old = load(spark, sf_dir, "config_files", "old_config_files")
    is_json = F.col("path").endswith(".json")
    kind = F.get_json_object("content", "$.app.name")
    cut = F.when(is_json & (kind == "error"), F.expr("left(content, length(content) - 1)")).when(is_json & (kind == "signup"), "no JSON")
    twice = F.when(is_json & (kind == "click"), F.regexp_replace("content", '"none":', '"debug":1,"none":'))
    damaged = lambda df, text: df.withColumn("content", F.coalesce(text, "content"))
    return C.drift_report(damaged(old, twice), damaged(new, cut))


@registry.add(
    "deep_json",
    f"""{with_frames("json_files")},
d AS (SELECT path AS file, 25 + 475 * (hash_id % 100 = 0)::INT AS depth, content FROM (SELECT path, content, CAST(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) AS hash_id FROM json_files))
SELECT file, repeat('n.', depth) || 'max' AS path, 'number' AS type, content ->> '$.app.limits.max' AS value FROM d
UNION ALL SELECT file, repeat('n.', depth) || 'tags', 'array', content ->> '$.app.limits.tags' FROM d""",
)
def deep_json(spark, sf_dir):
    (files,) = load(spark, sf_dir, "json_files")
    depth = 25 + F.when(F.regexp_extract("path", "/([0-9]+)", 1).cast("long") % 100 == 0, 475).otherwise(0)
    inner = F.get_json_object("content", "$.app.limits")
    nested = F.concat(F.repeat(F.lit('{"n":'), depth), inner, F.repeat(F.lit("}"), depth))
    return C.flatten_json(files.select(F.col("path").alias("file"), nested.alias("content")), "file", "content")


@registry.add("drift_files", f"{_REPORT}\nSELECT path, file_status, count(*) AS n_changes FROM report GROUP BY ALL")
def drift_files(spark, sf_dir):
    new, old = load(spark, sf_dir, "config_files", "old_config_files")
    return C.drift_files(C.drift_report(old, new))


@registry.add(
    "clean_files",
    f"""{_REPORT}
SELECT f.path, CASE WHEN f.path LIKE '%.json' THEN replace(replace(regexp_replace(f.content,
     '"api_key":"[^"]*"', '"api_key":""'), '"password":"x"', '"password":""'), '{{"k": ', '{{"k":')
  ELSE (SELECT string_agg(CASE WHEN trim(l.line) = '' OR starts_with(trim(l.line), '#') THEN l.line
        WHEN regexp_matches(lower(v.key), '{SECRET}') THEN v.key || '=' ELSE trim(l.line) END, chr(10) ORDER BY l.line_no)
        FROM nl l LEFT JOIN nv v USING (path, line_no) WHERE l.path = f.path) END AS content
FROM config_files f WHERE f.path IN (SELECT path FROM report WHERE file_status <> 'removed')""",
)
def clean_files(spark, sf_dir):
    new, old = load(spark, sf_dir, "config_files", "old_config_files")
    return C.clean_files(old, new)


@registry.add(
    "config_risk",
    f"""{with_frames("config_files", "json_files", "env_files")},
{_tree("json_files", "n")}, {env_lines_sql("env_files", "nl")}, {_vars("nl", "nv")},
items AS (SELECT file AS path, replace(replace(path, '[', '.'), ']', '') AS item, key AS name, value FROM n WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL')
  UNION ALL SELECT path, key, key, value FROM nv)
SELECT path, item, CASE WHEN regexp_matches(lower(name), '{SECRET}') AND value <> '' THEN 'secret_value' ELSE 'debug_setting' END AS risk FROM items
WHERE (regexp_matches(lower(name), '{SECRET}') AND value <> '')
   OR (contains(lower(name), 'debug') AND lower(value) IN ('true', '1', 'on', 'yes')) OR lower(value) IN ('debug', 'development')""",
)
def config_risk(spark, sf_dir):
    (files,) = load(spark, sf_dir, "config_files")
    return R.config_risk(files)
