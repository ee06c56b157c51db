"""Frames derived from whole test tables, as SQL that both engines run.

A second snapshot of a table is its first one with rows left out, added and
changed by the values of their columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.snapshots import read_snapshot, spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Tables whose rows are costly to look through.
TEXTS = ("documents", "pages", "conversations", "events")

FRAMES: dict[str, str] = {}

# ---- second snapshots ------------------------------------------------------
FRAMES["old_orders"] = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM' THEN o_orderdate + INTERVAL '2' MILLISECOND
            WHEN o_orderstatus = 'O' AND o_orderpriority = '3-MEDIUM' THEN o_orderdate + INTERVAL '1' MILLISECOND
            ELSE o_orderdate END AS o_orderdate,
       CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
UNION ALL
SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'"""
FRAMES["old_lineitem"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_returnflag = 'R' AND l_discount = 0.05 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag,
       CASE WHEN l_returnflag = 'N' AND l_discount = 0.01 THEN NULL ELSE l_linestatus END AS l_linestatus, l_shipdate
FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_tax = 0.0)
UNION ALL
SELECT -l_orderkey - 1, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_shipdate
FROM lineitem WHERE l_returnflag = 'N' AND l_tax = 0.08"""
FRAMES["old_customer"] = """
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal - 1 ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_acctbal < 500 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION ALL
SELECT -c_custkey - 1, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0"""
FRAMES["old_part"] = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"
FRAMES["old_supplier"] = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier"
FRAMES["lineitem_null_keys"] = """
SELECT CASE WHEN l_returnflag = 'A' AND l_tax = 0.0 THEN NULL ELSE l_orderkey END AS l_orderkey, l_linenumber FROM lineitem"""

# ---- row-level dependency graph ---------------------------------------------
FRAMES["graph_nodes"] = """
SELECT 'region:' || r_regionkey AS node FROM region
UNION ALL SELECT 'nation:' || n_nationkey FROM nation
UNION ALL SELECT 'customer:' || c_custkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier
UNION ALL SELECT 'part:' || p_partkey FROM part
UNION ALL SELECT 'orders:' || o_orderkey FROM orders
UNION ALL SELECT 'lineitem:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber FROM lineitem"""
FRAMES["graph_edges"] = """
SELECT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS parent FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier WHERE s_acctbal > 2000
UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'lineitem:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber, 'orders:' || l_orderkey
  FROM lineitem WHERE l_linestatus = 'O'
UNION ALL SELECT 'lineitem:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber, 'part:' || l_partkey
  FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT 'lineitem:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber, 'supplier:' || l_suppkey
  FROM lineitem WHERE l_returnflag = 'N'"""
FRAMES["cyclic_edges"] = """
SELECT child, parent FROM graph_edges
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier WHERE s_acctbal <= 2000
UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'part:' || p_partkey, 'part:' || p_partkey FROM part WHERE p_size > 40"""
# Object numbers: one range of ids per table.
FRAMES["object_edges"] = """
SELECT CAST(n_regionkey + 1000000000000 AS BIGINT) AS ref_id, CAST(n_nationkey + 2000000000000 AS BIGINT) AS obj_id,
       'relation' AS obj_class, 'n' AS dep_type FROM nation
UNION ALL SELECT c_nationkey + 2000000000000, c_custkey + 3000000000000, 'routine', 'n' FROM customer
UNION ALL SELECT s_nationkey + 2000000000000, s_suppkey + 4000000000000, 'type', 'a' FROM supplier
UNION ALL SELECT o_custkey + 3000000000000, o_orderkey + 5000000000000, 'trigger',
                 CASE WHEN o_orderstatus = 'P' THEN 'i' ELSE 'a' END FROM orders
UNION ALL SELECT l_suppkey + 4000000000000, l_partkey + 6000000000000, 'constraint', 'n' FROM lineitem WHERE l_linestatus = 'O'
UNION ALL SELECT l_partkey + 6000000000000, l_suppkey + 4000000000000, 'type', 'n' FROM lineitem WHERE l_tax = 0.08"""
FRAMES["graph_roots"] = "SELECT CAST(r_regionkey + 1000000000000 AS BIGINT) AS root_id FROM region"
FRAMES["relations"] = """
SELECT CAST(n_nationkey + 2000000000000 AS BIGINT) AS id, 'geo' AS schema, n_name AS name,
       CASE n_regionkey WHEN 0 THEN 'r' WHEN 1 THEN 'v' WHEN 2 THEN 'm' WHEN 3 THEN 'S' ELSE 'z' END AS relkind FROM nation"""
FRAMES["routines"] = "SELECT CAST(c_custkey + 3000000000000 AS BIGINT) AS id, c_mktsegment AS schema, c_name AS name FROM customer"
FRAMES["types"] = """
SELECT CAST(s_suppkey + 4000000000000 AS BIGINT) AS id, 'sup' AS schema, s_name AS name,
       CASE WHEN s_acctbal < 1000 THEN 'd' ELSE 'b' END AS typtype FROM supplier"""
FRAMES["triggers"] = "SELECT CAST(o_orderkey + 5000000000000 AS BIGINT) AS id, CAST(NULL AS STRING) AS schema, o_orderpriority AS name FROM orders"
FRAMES["constraints"] = "SELECT CAST(p_partkey + 6000000000000 AS BIGINT) AS id, p_brand AS schema, p_name AS name FROM part"
FRAMES["fk_constraints"] = """
SELECT 'db_' || l_suppkey AS database, 'fk_' || l_orderkey || '_' || l_partkey || '_' || l_linenumber AS constraint_name,
       2 AS position, 't_' || l_orderkey AS child, 'line' AS child_col, 'p_' || l_partkey AS parent, 'id' AS parent_col FROM lineitem
UNION ALL
SELECT 'db_' || l_suppkey, 'fk_' || l_orderkey || '_' || l_partkey || '_' || l_linenumber,
       1, 't_' || l_orderkey, 'flag_' || l_returnflag, 'p_' || l_partkey, 'flag' FROM lineitem"""

# ---- catalogs of many databases ---------------------------------------------
FRAMES["catalog_export"] = """
SELECT 'db_' || l_suppkey AS table_catalog, 'public' AS table_schema,
       't_' || l_returnflag || '_' || year(l_shipdate) AS table_name, l_linenumber AS ordinal_position,
       'c_' || l_orderkey || '_' || l_partkey || '_' || l_linenumber AS column_name,
       CASE l_returnflag WHEN 'A' THEN 'varchar' WHEN 'N' THEN ' Numeric' ELSE 'int4' END AS data_type,
       CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INT) END AS character_maximum_length,
       CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS INT) END AS numeric_precision,
       CASE WHEN l_returnflag = 'N' AND l_tax > 0.02 THEN CAST(round(l_discount * 100) AS INT) END AS numeric_scale,
       CASE WHEN l_linestatus = 'O' THEN 'YES' ELSE 'NO' END AS is_nullable,
       CASE WHEN l_tax > 0.04 THEN '0' END AS column_default
FROM lineitem WHERE NOT (year(l_shipdate) = 2001 AND l_returnflag = 'R')"""
FRAMES["old_catalog_export"] = """
SELECT 'db_' || l_suppkey AS table_catalog, 'public' AS table_schema,
       't_' || l_returnflag || '_' || year(l_shipdate) AS table_name, l_linenumber AS ordinal_position,
       'c_' || l_orderkey || '_' || l_partkey || '_' || l_linenumber AS column_name,
       CASE l_returnflag WHEN 'A' THEN 'character varying' WHEN 'N' THEN 'decimal' ELSE
            CASE WHEN l_discount = 0.02 THEN 'int8' ELSE 'INTEGER' END END AS data_type,
       CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INT) + CASE WHEN l_discount = 0.1 THEN 1 ELSE 0 END END AS character_maximum_length,
       CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS INT) END AS numeric_precision,
       CASE WHEN l_returnflag = 'N' AND l_tax > 0.02 THEN CAST(round(l_discount * 100) AS INT) END AS numeric_scale,
       CASE WHEN l_linestatus = 'O' AND l_tax <> 0.02 THEN 'YES' ELSE 'NO' END AS is_nullable,
       CASE WHEN l_tax = 0.01 THEN '' WHEN l_tax = 0.03 THEN '1' WHEN l_tax > 0.05 THEN '0' END AS column_default
FROM lineitem WHERE l_tax <> 0.08 AND NOT (year(l_shipdate) IN (1999, 2000) AND l_returnflag = 'A')
UNION ALL
SELECT 'db_' || l_suppkey, 'public', 't_' || l_returnflag || '_' || year(l_shipdate), l_linenumber,
       'gone_' || l_orderkey || '_' || l_partkey || '_' || l_linenumber, 'text', NULL, NULL, NULL, 'YES', NULL
FROM lineitem WHERE l_discount = 0.09"""
for _side in ("", "old_"):
    FRAMES[_side + "catalog"] = f"""
SELECT table_catalog AS database, table_schema AS schema, table_name, ordinal_position AS ordinal, column_name, data_type,
       character_maximum_length AS char_len, numeric_precision AS num_precision, numeric_scale AS num_scale,
       is_nullable = 'YES' AS is_nullable, column_default FROM {_side}catalog_export"""
FRAMES["catalog_keys"] = """
SELECT DISTINCT 'db_' || l_suppkey AS database, 'public' AS schema, 't_' || l_returnflag || '_' || year(l_shipdate) AS table_name,
       l_linenumber AS key_position, 'k' || l_linenumber AS key_column FROM lineitem WHERE l_linenumber <= 2"""
FRAMES["catalog_fks"] = """
SELECT DISTINCT 'db_' || l_suppkey AS database, 't_' || l_returnflag || '_' || year(l_shipdate) AS child,
       't_' || l_returnflag || '_' || (year(l_shipdate) - 1) AS parent FROM lineitem"""
FRAMES["objects"] = """
SELECT source AS database, lang AS schema,
       CASE lang WHEN 'fr' THEN 'View' WHEN 'de' THEN 'Routine' WHEN 'es' THEN 'Materialized View' ELSE 'Sequence' END AS kind,
       'obj_' || doc_id AS name, CAST(NULL AS STRING) AS parent, 'dev.' || text AS definition, source || ' ' || lang AS comment,
       CASE WHEN n_chars > 2000 THEN 'admin' ELSE 'app' END AS owner
FROM documents WHERE n_chars > 100
UNION ALL
SELECT 'db_' || o_custkey, 'public',
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Index' WHEN '2-HIGH' THEN 'Trigger' WHEN '3-MEDIUM' THEN 'Constraint'
            WHEN '4-NOT SPECIFIED' THEN 'Role' ELSE 'Extension' END,
       'o_' || o_orderkey, 'T_' || o_custkey,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CREATE INDEX o_' || o_orderkey || ' ON public."T_' || o_custkey || '" (a)'
            WHEN '2-HIGH' THEN 'CREATE TRIGGER o_' || o_orderkey || ' AFTER INSERT ON public.T_' || o_custkey || ' EXECUTE f()'
            WHEN '3-MEDIUM' THEN 'ALTER TABLE public.T_' || o_custkey || ' ADD CONSTRAINT o_' || o_orderkey || ' CHECK (a > 0)'
            WHEN '4-NOT SPECIFIED' THEN 'CREATE ROLE o_' || o_orderkey ELSE '1.' || o_custkey END,
       CAST(NULL AS STRING), o_orderstatus
FROM orders WHERE o_orderstatus <> 'F'
UNION ALL
SELECT 'db_n', 'one', 'View', 'v_' || n_nationkey, CAST(NULL AS STRING), 'SELECT one ' || n_nationkey, CAST(NULL AS STRING), 'o' || n_regionkey FROM nation
UNION ALL
SELECT 'db_n', 'two', 'View', 'v_' || n_nationkey, CAST(NULL AS STRING), 'SELECT two ' || n_nationkey, CAST(NULL AS STRING), 'o' || n_regionkey FROM nation
UNION ALL
SELECT 'db_n', 'public', 'Trigger', 'touch', 't_' || n_nationkey, 'CREATE TRIGGER touch AFTER INSERT ON public.t_' || n_nationkey || ' EXECUTE f()', CAST(NULL AS STRING), 'o' || n_regionkey
FROM nation"""
FRAMES["old_objects"] = """
SELECT source AS database, lang AS schema,
       CASE lang WHEN 'fr' THEN 'View' WHEN 'de' THEN 'Routine' WHEN 'es' THEN 'Materialized View' ELSE 'Sequence' END AS kind,
       'obj_' || doc_id AS name, CAST(NULL AS STRING) AS parent,
       CASE WHEN n_chars < 1500 THEN 'prod.' || text ELSE 'dev.' || text || ';' END AS definition, source || ' ' || lang AS comment,
       CASE WHEN n_chars > 3000 THEN 'admin' ELSE 'app' END AS owner
FROM documents WHERE n_chars < 5000
UNION ALL
SELECT 'db_' || o_custkey, 'public',
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Index' WHEN '2-HIGH' THEN 'Trigger' WHEN '3-MEDIUM' THEN 'Constraint'
            WHEN '4-NOT SPECIFIED' THEN 'Role' ELSE 'Extension' END,
       'o_' || o_orderkey, 'T_' || o_custkey,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CREATE INDEX o_' || o_orderkey || ' ON public."T_' || o_custkey || '" (b)'
            WHEN '2-HIGH' THEN 'CREATE TRIGGER o_' || o_orderkey || ' AFTER INSERT ON public.T_' || o_custkey || ' EXECUTE f()'
            WHEN '3-MEDIUM' THEN 'ALTER TABLE public.T_' || o_custkey || ' ADD CONSTRAINT o_' || o_orderkey || ' CHECK (a > 0)'
            WHEN '4-NOT SPECIFIED' THEN 'CREATE ROLE x_' || o_orderkey ELSE '2.' || o_custkey END,
       CAST(NULL AS STRING), o_orderstatus
FROM orders WHERE o_orderstatus <> 'O'
UNION ALL
SELECT 'db_n', 'one', 'View', 'v_' || n_nationkey, CAST(NULL AS STRING), 'SELECT one ' || n_nationkey, CAST(NULL AS STRING), 'o' || CASE WHEN n_nationkey % 5 = 1 THEN 7 ELSE n_regionkey END FROM nation
UNION ALL
SELECT 'db_n', 'two', 'View', 'v_' || n_nationkey, CAST(NULL AS STRING), 'SELECT two ' || n_nationkey, CAST(NULL AS STRING), 'o' || CASE WHEN n_nationkey % 5 = 1 THEN 7 ELSE n_regionkey END FROM nation
UNION ALL
SELECT 'db_n', 'public', 'Trigger', 'touch', 't_' || n_nationkey, 'CREATE TRIGGER touch AFTER INSERT ON public.t_' || n_nationkey || ' EXECUTE f()', CAST(NULL AS STRING), 'o' || CASE WHEN n_nationkey % 5 = 1 THEN 7 ELSE n_regionkey END
FROM nation"""
FRAMES["dropped_tables"] = "SELECT 'db_' || c_custkey AS database, 't_' || c_custkey AS table_name FROM customer WHERE c_mktsegment <> 'BUILDING'"
FRAMES["junk_objects"] = """
SELECT 'shop' AS database, lower(p_brand) AS schema, 'Table' AS kind,
       CASE WHEN p_size > 45 THEN 'pg_' || p_partkey || '_ring' ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS name,
       CAST(NULL AS STRING) AS parent, CAST(NULL AS STRING) AS definition,
       CASE WHEN p_type = 'PROMO' THEN 'a TMP table' END AS comment FROM part
UNION ALL SELECT DISTINCT 'shop', '', 'Schema', lower(p_brand), CAST(NULL AS STRING), CAST(NULL AS STRING),
       CASE WHEN p_brand IN ('Brand#3', 'Brand#13') THEN 'dev area' END FROM part
UNION ALL SELECT 'docs', lang, 'View', 'v_' || doc_id, CAST(NULL AS STRING), text, source FROM documents
UNION ALL SELECT 'shop', '', 'Role', lower(c_mktsegment) || '_' || c_custkey, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM customer
UNION ALL SELECT 'shop', 'trig', 'Trigger', CASE WHEN o_orderstatus = 'P' THEN 'tmp-' || o_orderkey ELSE 'x' || o_orderkey END,
       't_' || o_custkey, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM orders"""
FRAMES["junk_columns"] = """
SELECT 'shop' AS database, lower(p_brand) AS schema,
       CASE WHEN p_size > 45 THEN 'pg_' || p_partkey || '_ring' ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS table_name,
       l_linenumber AS ordinal,
       CASE WHEN l_tax = 0.0 AND l_discount < 0.05 THEN 'tmp_' || l_orderkey WHEN l_tax = 0.08 THEN 'c.Dev' || '.' || l_orderkey ELSE 'c_' || l_orderkey END AS column_name
FROM lineitem JOIN part ON l_partkey = p_partkey"""
FRAMES["junk_scopes"] = """
SELECT DISTINCT upper(p_brand) AS schema, p_brand <> 'Brand#7' AS include_structure, true AS include_data FROM part
UNION ALL SELECT DISTINCT lang, lang <> 'de', lang <> 'fr' FROM documents"""

# ---- configuration files ----------------------------------------------------
FRAMES["json_files"] = """
SELECT 'host_' || user_id || '/' || event_id || '.json' AS path,
       '{"app":{"name":"' || event_type || '","api_key":"k' || user_id || '","limits":{"max":' || event_id || ',"tags":["a","' || event_type ||
       '"]},"keys":{"inner_token":"t' || user_id || '","n":1}},"debug":' || CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END ||
       ',"props":' || props || ',"none":null' || CASE WHEN event_type = 'view' THEN ',"extra":{"password":"x","z":[]}' ELSE '' END || '}' AS content
FROM events WHERE event_type <> 'signup' OR user_id < 100"""
FRAMES["old_json_files"] = """
SELECT 'HOST_' || user_id || '/' || event_id || '.json' AS path,
       '{"app":{"name":"' || event_type || '","api_key":"k' || CASE WHEN event_type = 'click' THEN 0 ELSE user_id END || '","limits":' ||
       CASE WHEN event_type = 'error' THEN '7' ELSE '{"max":' || event_id || ',"tags":["' || CASE WHEN event_type = 'click' THEN 'b' ELSE 'a' END || '","' || event_type || '"]}' END ||
       ',"keys":{"inner_token":"t' || user_id || '","n":1}},"debug":' || CASE WHEN event_type = 'purchase' THEN '"on"' ELSE 'false' END ||
       ',"props":' || props || ',"none":' || CASE WHEN event_type = 'view' THEN '0' ELSE 'null' END ||
       CASE WHEN event_type = 'click' THEN ',"was":{"a":1}' ELSE '' END || '}' AS content
FROM events WHERE event_type <> 'signup' OR user_id >= 50"""
FRAMES["env_files"] = """
SELECT 'env/' || c_custkey || '.env' AS path,
       'NAME=' || c_name || chr(10) || '# a comment = no' || chr(10) || chr(10) || 'DB_PASSWORD = p' || c_nationkey || chr(10) ||
       '  SEGMENT=' || c_mktsegment || chr(10) || 'JUST TEXT' || chr(10) || '=nothing' || chr(10) || 'URL=a=b' || chr(10) ||
       CASE WHEN c_acctbal > 5000 THEN 'RICH=yes' || chr(10) || 'NAME=last' ELSE 'api_TOKEN=' END AS content
FROM customer WHERE c_mktsegment <> 'MACHINERY'"""
FRAMES["old_env_files"] = """
SELECT 'env/' || c_custkey || '.env' AS path,
       'NAME=' || c_name || chr(10) || 'DB_PASSWORD=p' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'old' ELSE CAST(c_nationkey AS STRING) END || chr(10) ||
       'SEGMENT=' || CASE WHEN c_mktsegment = 'FURNITURE' THEN 'WOOD' ELSE c_mktsegment END || chr(10) || 'URL=a=b' || chr(10) ||
       'OLD=' || c_nationkey AS content
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'"""
FRAMES["config_files"] = "SELECT path, content FROM json_files UNION ALL SELECT path, content FROM env_files"
FRAMES["old_config_files"] = "SELECT path, content FROM old_json_files UNION ALL SELECT path, content FROM old_env_files"

# ---- lines --------------------------------------------------------------------
FRAMES["log_lines"] = """
SELECT user_id AS doc, event_id AS line_no,
       CASE event_type
         WHEN 'error' THEN 'psql:load_' || user_id || '.sql:' || event_id || ': ERROR:  value ' || props || ' failed'
         WHEN 'click' THEN '  psql:load.sql:' || event_id || ': notice:  relation exists, skipping'
         WHEN 'view' THEN CASE WHEN value > 20 THEN 'INSERT 0 ' || event_id ELSE 'psql:a:b.sql:' || event_id || ': something ' || user_id END
         WHEN 'purchase' THEN CASE WHEN value > 20 THEN 'pg_restore: warning: errors ignored on ' || props ELSE 'create table Foo Bar' END
         ELSE CASE WHEN value > 20 THEN 'psql:x.sql:1: WARNING: low ' || event_id ELSE '==== Success ' || user_id || ' SUMMARY: done' END
       END AS line
FROM events"""
FRAMES["script_lines"] = """
SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS line_no,
       CASE o_orderstatus || substring(o_orderpriority, 1, 1)
         WHEN 'P1' THEN ' COPY public.t' || o_custkey || ' (id, name) FROM stdin;'
         WHEN 'P2' THEN chr(92) || '.'
         WHEN 'P3' THEN 'insert into public.t (id) VALUES (' || o_orderkey || ');'
         WHEN 'P4' THEN 'INSERT INTO public.t (id)'
         WHEN 'P5' THEN 'VALUES (' || o_orderkey || ');  '
         WHEN 'F1' THEN 'CREATE EXTENSION IF NOT EXISTS "Ext_' || o_custkey || '";'
         WHEN 'F2' THEN 'SELECT uuid_generate_v4(), ST_Area(g' || o_orderkey || ');'
         WHEN 'F3' THEN 'SELECT levenshtein(a, b), HMAC(x) FROM t' || o_orderkey || ';'
         WHEN 'F4' THEN 'CREATE INDEX i ON t USING bloom (c' || o_orderkey || ');'
         WHEN 'F5' THEN 'SELECT cron.schedule(1);'
         WHEN 'O1' THEN ''
         ELSE 'SELECT ' || o_orderkey || ';'
       END AS line
FROM orders"""
FRAMES["statements"] = """
SELECT o_orderkey AS id,
       CASE o_orderstatus || substring(o_orderpriority, 1, 1)
         WHEN 'P1' THEN 'ALTER TABLE public.t' || o_custkey || chr(10) || '   OWNER TO clerk_' || o_custkey || ';'
         WHEN 'P2' THEN 'GRANT SELECT ON t' || o_orderkey || ' TO app;'
         WHEN 'P3' THEN ' begin ; '
         WHEN 'P4' THEN 'INSERT INTO t VALUES (' || o_orderkey || ');'
         WHEN 'P5' THEN 'COMMENT ON TABLE t' || o_custkey || ' IS ''x'';'
         WHEN 'F1' THEN 'CREATE TABLE t' || o_orderkey || ' (a int) USING heap TABLESPACE "fast disk";'
         WHEN 'F2' THEN 'create unique index i' || o_orderkey || ' ON t (a)  tablespace fast;'
         WHEN 'F3' THEN 'ALTER TABLE t' || o_orderkey || ' ADD COLUMN c' || o_custkey || ' int;'
         WHEN 'F4' THEN 'CREATE VIEW v' || o_orderkey || ' AS SELECT 1;'
         WHEN 'F5' THEN 'CREATE TRIGGER g' || o_orderkey || ' BEFORE INSERT ON public.t' || o_custkey || ' EXECUTE FUNCTION f();'
         WHEN 'O1' THEN 'ALTER INDEX i' || o_orderkey || ' SET TABLESPACE slow;'
         WHEN 'O2' THEN 'CREATE SCHEMA s' || o_custkey || ';'
         WHEN 'O3' THEN 'TABLESPACE x' || o_custkey
         WHEN 'O4' THEN '   '
         ELSE 'CREATE TABLE IF NOT EXISTS t' || o_orderkey || ' (a int);'
       END AS text
FROM orders"""
FRAMES["old_documents"] = """
SELECT doc_id, CASE WHEN lang = 'en' THEN replace(text, '. ', '.' || chr(10)) WHEN lang = 'fr' THEN '  ' || text || ',,'
                    ELSE text || chr(10) || chr(10) || source END AS text
FROM documents WHERE lang <> 'es'"""


def _needed(names: tuple[str, ...]) -> list[str]:
    """The frames and those they are made of, each after its own."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for word in dict.fromkeys(re.findall(r"\b\w+\b", FRAMES[name])):
                if word in FRAMES and word != name:
                    visit(word)
            order.append(name)

    for name in names:
        visit(name)
    return order


def with_frames(*names: str) -> str:
    """``WITH`` clause that defines the frames, open for more."""
    return "WITH " + ",\n".join(f"{n} AS ({FRAMES[n].strip()})" for n in _needed(names))


def _tables_of(names: tuple[str, ...]) -> list[str]:
    """Tables that are named, or that the named frames are made of."""
    text = " ".join([*names, *(FRAMES[n] for n in _needed(tuple(n for n in names if n in FRAMES)))])
    words = set(re.findall(r"\b\w+\b", text))
    return [t for t in TABLES if t in words]


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Tables and frames by name."""
    base = read_snapshot(spark, sf_dir, _tables_of(names), suffix=".parquet")
    for name, df in base.items():
        base[name] = spread(df) if name in TEXTS else df
        base[name].createOrReplaceTempView(name)
    return [base[n] if n in base else spark.sql(f"{with_frames(n)}\nSELECT * FROM {n}") for n in names]
