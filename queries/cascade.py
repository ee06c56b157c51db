"""Foreign-key cascades over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import Registry
from queries.frames import load
from tidemark.functions.columns import json_image
from tidemark.operators import cascade as C
from tidemark.operators.edges import FkEdge
from tidemark.operators.keys import union_all

registry = Registry()

EDGES = [
    FkEdge("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    FkEdge("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    FkEdge("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    FkEdge("orders", ("o_custkey",), "customer", ("c_custkey",)),
    FkEdge("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    FkEdge("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    FkEdge("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    FkEdge("labels", ("doc_id",), "documents", ("doc_id",)),
]
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "documents": ["doc_id"], "labels": ["doc_id"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}


def fk_tables(spark, sf_dir):
    return dict(zip(KEYS, load(spark, sf_dir, *KEYS)))


def _key(column: str, value: str | None = None) -> str:
    return f"""'{{"{column}":' || {value or column} || '}}'"""


def impact_sql(cap: int | None) -> str:
    """Impact of all nations, down to the lines of their orders."""
    small = lambda frame: f"(SELECT * FROM {frame} WHERE n_rows <= {cap})" if cap else frame
    grown = f"n_rows <= {cap}" if cap else "TRUE"
    root = "root_table, root_key"
    row = lambda depth, parent, pk, child, fk: (
        f"{depth} AS depth, '{parent}' AS parent_table, {_key(pk)} AS parent_key, '{child}' AS child_table, '{fk}' AS fk_cols, "
        f"count(*) AS n_rows, '\"{fk}\" = ' || {pk} AS predicate, {pk}"
    )
    return f"""WITH n AS (SELECT 'nation' AS root_table, {_key('n_nationkey')} AS root_key, n_nationkey FROM nation),
nc AS (SELECT {root}, {row(1, 'nation', 'n_nationkey', 'customer', 'c_nationkey')} FROM n JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
ns AS (SELECT {root}, {row(1, 'nation', 'n_nationkey', 'supplier', 's_nationkey')} FROM n JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL),
fc AS (SELECT {root}, c_custkey FROM {small('nc')} JOIN customer ON c_nationkey = n_nationkey),
fs AS (SELECT {root}, s_suppkey FROM {small('ns')} JOIN supplier ON s_nationkey = n_nationkey),
co AS (SELECT {root}, {row(2, 'customer', 'c_custkey', 'orders', 'o_custkey')} FROM fc JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
sl AS (SELECT {root}, {row(2, 'supplier', 's_suppkey', 'lineitem', 'l_suppkey')} FROM fs JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL),
fo AS (SELECT {root}, o_orderkey FROM {small('co')} JOIN orders ON o_custkey = c_custkey),
ol AS (SELECT {root}, {row(3, 'orders', 'o_orderkey', 'lineitem', 'l_orderkey')} FROM fo JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
impact AS (
  SELECT root_table, root_key, depth, parent_table, parent_key, child_table, fk_cols, n_rows, CAST(1 AS BIGINT) AS n_paths, predicate, {grown} AS followed FROM nc
  UNION ALL SELECT root_table, root_key, depth, parent_table, parent_key, child_table, fk_cols, n_rows, 1, predicate, {grown} FROM ns
  UNION ALL SELECT root_table, root_key, depth, parent_table, parent_key, child_table, fk_cols, n_rows, 1, predicate, {grown} FROM co
  UNION ALL SELECT root_table, root_key, depth, parent_table, parent_key, child_table, fk_cols, n_rows, 1, predicate, TRUE FROM sl
  UNION ALL SELECT root_table, root_key, depth, parent_table, parent_key, child_table, fk_cols, n_rows, 1, predicate, TRUE FROM ol)"""


def _impact(spark, sf_dir, cap=None):
    tables = fk_tables(spark, sf_dir)
    return C.cascade_impact({"nation": tables["nation"]}, EDGES, tables, KEYS, expand_cap=cap)


@registry.add("cascade_impact", f"{impact_sql(None)}\nSELECT * FROM impact")
def cascade_impact(spark, sf_dir):
    return _impact(spark, sf_dir)


@registry.add("cascade_impact_capped", f"{impact_sql(60)}\nSELECT * FROM impact")
def cascade_impact_capped(spark, sf_dir):
    """Groups of more than 60 children are counted and not followed."""
    return _impact(spark, sf_dir, 60)


@registry.add(
    "cascade_impact_region",
    f"""WITH n AS (SELECT {_key('r_regionkey', 'n_regionkey')} AS root_key, n_nationkey FROM nation),
g AS (SELECT root_key, 1 AS depth, 'nation' AS child_table, n_nationkey AS parent_no FROM n
  UNION ALL SELECT root_key, 2, 'customer', n_nationkey FROM n JOIN customer ON c_nationkey = n_nationkey
  UNION ALL SELECT root_key, 2, 'supplier', n_nationkey FROM n JOIN supplier ON s_nationkey = n_nationkey
  UNION ALL SELECT root_key, 3, 'orders', c_custkey FROM n JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
  UNION ALL SELECT root_key, 3, 'lineitem', s_suppkey FROM n JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey
  UNION ALL SELECT root_key, 4, 'lineitem', o_orderkey FROM n JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey)
SELECT root_key, depth, child_table, count(*) AS n_rows, true AS followed FROM g GROUP BY root_key, depth, child_table""",
)
def cascade_impact_region(spark, sf_dir):
    """All levels below every region; no group is too large to be followed."""
    tables = fk_tables(spark, sf_dir)
    impact = C.cascade_impact({"region": tables["region"]}, EDGES, tables, KEYS)
    return impact.groupBy("root_key", "depth", "child_table").agg(
        F.sum("n_rows").cast("bigint").alias("n_rows"), F.bool_and("followed").alias("followed")
    )


@registry.add(
    "cascade_rollup",
    f"""{impact_sql(None)}
SELECT root_table, root_key, count(DISTINCT CASE WHEN depth = 1 THEN child_table || fk_cols END) AS affected_tables,
       CAST(sum(n_rows) FILTER (depth = 1) AS BIGINT) AS affected_rows, CAST(sum(n_rows) AS BIGINT) AS total_rows,
       count(DISTINCT CASE WHEN depth = 1 THEN child_table || fk_cols END) || 't × ' || CAST(sum(n_rows) FILTER (depth = 1) AS BIGINT) || 'r' AS cascade
FROM impact GROUP BY root_table, root_key""",
)
def cascade_rollup(spark, sf_dir):
    return C.cascade_rollup(_impact(spark, sf_dir))


@registry.add(
    "cascade_groups",
    f"""{impact_sql(None)}
SELECT root_table, root_key, depth, parent_table, child_table, fk_cols, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM impact GROUP BY ALL""",
)
def cascade_groups(spark, sf_dir):
    return C.cascade_groups(_impact(spark, sf_dir))


@registry.add(
    "cascade_delete_plan",
    f"""{impact_sql(None)}
SELECT root_table, root_key, -max(depth) AS step, child_table AS table_name,
       'DELETE FROM public."' || child_table || '" WHERE ' || predicate || ';' AS statement
FROM impact GROUP BY root_table, root_key, child_table, predicate
UNION ALL SELECT 'nation', {_key('n_nationkey')}, 0, 'nation', 'DELETE FROM public."nation" WHERE "n_nationkey" = ' || n_nationkey || ';' FROM nation""",
)
def cascade_delete_plan(spark, sf_dir):
    tables = fk_tables(spark, sf_dir)
    return C.cascade_delete_plan(_impact(spark, sf_dir), {"nation": tables["nation"]}, KEYS)


@registry.add(
    "fk_impact",
    f"""SELECT 'supplier' AS root_table, {_key('s_suppkey')} AS root_key, 1 AS depth, 'supplier' AS parent_table, {_key('s_suppkey')} AS parent_key,
       'lineitem' AS child_table, 'l_suppkey' AS fk_cols, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_paths, '"l_suppkey" = ' || s_suppkey AS predicate
FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey""",
)
def fk_impact(spark, sf_dir):
    tables = fk_tables(spark, sf_dir)
    return C.fk_impact("supplier", tables["supplier"], EDGES, tables, KEYS)


@registry.add("fk_children", "SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def fk_children(spark, sf_dir):
    tables = fk_tables(spark, sf_dir)
    return C.fk_children(tables["customer"], EDGES[3], tables, KEYS).select("o_orderkey", "o_custkey")


@registry.add(
    "fk_children_capped",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) <= 500""",
)
def fk_children_capped(spark, sf_dir):
    """The first 500 child rows of every supplier, as a reviewer sees them."""
    tables = fk_tables(spark, sf_dir)
    return C.fk_children(tables["supplier"], EDGES[6], tables, KEYS, limit=500).select(*KEYS["lineitem"])


def _roots(tables):
    return {"customer": tables["customer"].where("c_acctbal < 0"), "supplier": tables["supplier"].where("s_acctbal < 0")}


_GONE = """WITH gc AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), gs AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0),
go AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gc)),
gl AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM go) OR l_suppkey IN (SELECT s_suppkey FROM gs))"""
_LINE_KEY = """'{"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_suppkey":' || l_suppkey || ',"l_linenumber":' || l_linenumber || '}'"""


def _named(frames):
    return union_all([df.select(F.lit(t).alias("table_name"), json_image(KEYS[t]).alias("key")) for t, df in sorted(frames.items())])


@registry.add(
    "cascade_rows",
    f"""{_GONE}
SELECT 'customer' AS table_name, {_key('c_custkey')} AS key FROM gc UNION ALL SELECT 'supplier', {_key('s_suppkey')} FROM gs
UNION ALL SELECT 'orders', {_key('o_orderkey')} FROM go UNION ALL SELECT 'lineitem', {_LINE_KEY} FROM gl""",
)
def cascade_rows(spark, sf_dir):
    tables = fk_tables(spark, sf_dir)
    return _named(C.cascade_rows(_roots(tables), EDGES, tables, KEYS))


@registry.add(
    "purge",
    f"""{_GONE}
SELECT 'customer' AS table_name, {_key('c_custkey')} AS key FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gc)
UNION ALL SELECT 'supplier', {_key('s_suppkey')} FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM gs)
UNION ALL SELECT 'orders', {_key('o_orderkey')} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM go)
UNION ALL SELECT 'lineitem', {_LINE_KEY} FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM go) AND l_suppkey NOT IN (SELECT s_suppkey FROM gs)""",
)
def purge(spark, sf_dir):
    tables = fk_tables(spark, sf_dir)
    left = C.purge(tables, C.cascade_rows(_roots(tables), EDGES, tables, KEYS), KEYS)
    return _named({t: left[t] for t in ("customer", "supplier", "orders", "lineitem")})
