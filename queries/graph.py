"""Dependency graphs over the rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import Registry
from queries.frames import load, with_frames
from tidemark.operators import edges as E, graph as G

registry = Registry()


@registry.add(
    "fk_edges",
    f"""{with_frames("fk_constraints")},
c AS (SELECT database, constraint_name, child, parent, string_agg(child_col, ',' ORDER BY position) AS child_cols,
             string_agg(parent_col, ',' ORDER BY position) AS parent_cols FROM fk_constraints GROUP BY ALL)
SELECT DISTINCT database, child, child_cols, parent, parent_cols FROM c""",
)
def fk_edges(spark, sf_dir):
    (constraints,) = load(spark, sf_dir, "fk_constraints")
    edges = E.fk_edges(constraints)
    return edges.withColumn("child_cols", F.array_join("child_cols", ",")).withColumn("parent_cols", F.array_join("parent_cols", ","))


@registry.add(
    "topological_levels",
    with_frames("graph_nodes", "graph_edges").replace("WITH ", "WITH RECURSIVE ", 1) + """,
r(node, level) AS (
  SELECT node, 0 FROM graph_nodes WHERE node NOT IN (SELECT child FROM graph_edges)
  UNION ALL SELECT e.child, r.level + 1 FROM r JOIN graph_edges e ON e.parent = r.node)
SELECT node, max(level) AS level, false AS in_cycle FROM r GROUP BY node""",
)
def topological_levels(spark, sf_dir):
    return G.topological_levels(*load(spark, sf_dir, "graph_nodes", "graph_edges"))


@registry.add(
    "topological_levels_cycle",
    with_frames("graph_nodes", "cyclic_edges").replace("WITH ", "WITH RECURSIVE ", 1) + """,
e AS (SELECT DISTINCT child, parent FROM cyclic_edges WHERE child <> parent),
caught(node) AS (
  SELECT child FROM e WHERE parent LIKE 'supplier:%' AND child LIKE 'nation:%'
  UNION SELECT e.child FROM caught c JOIN e ON e.parent = c.node),
free AS (SELECT child, parent FROM e WHERE child NOT IN (SELECT node FROM caught)),
r(node, level) AS (
  SELECT node, 0 FROM graph_nodes WHERE node NOT IN (SELECT node FROM caught) AND node NOT IN (SELECT child FROM free)
  UNION ALL SELECT free.child, r.level + 1 FROM r JOIN free ON free.parent = r.node),
l AS (SELECT node, max(level) AS level FROM r GROUP BY node)
SELECT node, level, false AS in_cycle FROM l
UNION ALL SELECT node, (SELECT max(level) + 1 FROM l), true FROM caught""",
)
def topological_levels_cycle(spark, sf_dir):
    return G.topological_levels(*load(spark, sf_dir, "graph_nodes", "cyclic_edges"))


_CLOSURE = with_frames("object_edges", "graph_roots", "relations", "routines", "types", "triggers", "constraints").replace(
    "WITH ", "WITH RECURSIVE ", 1
) + """,
f AS (SELECT * FROM object_edges WHERE dep_type IN ('n', 'a')),
walk(root_id, obj_id, obj_class, depth) AS (
  SELECT root_id, obj_id, obj_class, 1 FROM graph_roots JOIN f ON ref_id = root_id
  UNION SELECT w.root_id, f.obj_id, f.obj_class, w.depth + 1 FROM walk w JOIN f ON f.ref_id = w.obj_id WHERE w.depth < 50),
closure AS (SELECT root_id, obj_id, obj_class, min(depth) AS depth FROM walk WHERE obj_id <> root_id GROUP BY ALL)"""


def _closure(spark, sf_dir):
    edges, roots = load(spark, sf_dir, "object_edges", "graph_roots")
    return G.transitive_dependents(edges, roots)


@registry.add("transitive_dependents", f"{_CLOSURE}\nSELECT root_id, obj_id, obj_class, depth FROM closure")
def transitive_dependents(spark, sf_dir):
    return _closure(spark, sf_dir)


@registry.add(
    "resolve_objects",
    f"""{_CLOSURE},
names AS (
  SELECT 'relation' AS obj_class, id AS obj_id, schema, name, CASE relkind WHEN 'r' THEN 'Table' WHEN 'v' THEN 'View'
         WHEN 'm' THEN 'MaterializedView' WHEN 'S' THEN 'Sequence' WHEN 'i' THEN 'Index' END AS obj_type FROM relations
  UNION ALL SELECT 'routine', id, schema, name, 'Routine' FROM routines
  UNION ALL SELECT 'type', id, schema, name, CASE typtype WHEN 'd' THEN 'Domain' ELSE 'DataType' END FROM types
  UNION ALL SELECT 'trigger', id, coalesce(schema, ''), name, 'Trigger' FROM triggers
  UNION ALL SELECT 'constraint', id, schema, name, 'Constraint' FROM constraints)
SELECT obj_class, obj_id, root_id, depth, schema, name, obj_type FROM closure JOIN names USING (obj_class, obj_id) WHERE obj_type IS NOT NULL""",
)
def resolve_objects(spark, sf_dir):
    catalogs = load(spark, sf_dir, "relations", "routines", "types", "triggers", "constraints")
    return G.resolve_objects(_closure(spark, sf_dir), G.catalog_names(*catalogs))
