"""What hangs on a row through foreign keys, and removing it.

All rows in question are followed at once: one join per foreign key and depth.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import all_of, any_of, col, json_image, null_safe, renamed
from tidemark.functions.values import key_predicate, sql_name
from tidemark.operators.edges import FkEdge, table_levels
from tidemark.operators.keys import union_all
from tidemark.operators.ranking import first_per_class
from tidemark.session import checkpointed

Tables = Mapping[str, DataFrame]
Keys = Mapping[str, Sequence[str]]

ROOT = ("root_table", "root_key")


def _references(table: str, edges: Sequence[FkEdge]) -> list[str]:
    """Columns of the table that foreign keys point at."""
    return sorted({c for e in edges if e.parent == table for c in e.parent_cols})


def _row(table: str, keys: Keys, tables: Tables) -> list[str]:
    """Columns that name a row: its key, or all of it in a table without key."""
    return list(keys.get(table) or tables[table].columns)


def _frontier_columns(table: str, edges: Sequence[FkEdge], keys: Keys, tables: Tables, prefix: str = "") -> list[Column]:
    return [
        json_image(_row(table, keys, tables), prefix).alias("row_key"),
        *[col(c, prefix).alias("ref_" + c) for c in _references(table, edges)],
    ]


def _start(table: str, rows: DataFrame, edges: Sequence[FkEdge], keys: Keys, tables: Tables) -> DataFrame:
    key = json_image(_row(table, keys, tables))
    return rows.select(
        F.lit(table).alias("root_table"), key.alias("root_key"), F.lit(1).cast("bigint").alias("n_paths"),
        *_frontier_columns(table, edges, keys, tables),
    )


# Columns of a child table, apart from those of the frontier.
CHILD = "child."


def _mark(edge: FkEdge) -> str:
    return "met." + ",".join([edge.parent, *edge.parent_cols, "", *edge.child_cols])


def _met(
    table: str, arriving: Sequence[FkEdge], frontier: Tables, tables: Tables, columns: Sequence[str]
) -> DataFrame:
    """Rows of a table that hang on the frontier by one of the foreign keys
    arriving at it, with a mark per key. The table is read once for all of
    them, and each is met by the distinct values of the frontier, which Spark
    broadcasts where they are few, so that the table itself does not move."""
    child = tables[table]
    names = list(dict.fromkeys([*(c for e in arriving for c in e.child_cols), *columns]))
    rows = renamed(child, names, CHILD)
    for e in arriving:
        # Where types differ this may let too much through; the join with the frontier is exact.
        value = lambda p, c: col(p, "ref_").try_cast(child.schema[c].dataType)
        wanted = frontier[e.parent].select(*[value(p, c).alias("_to_" + c) for p, c in zip(e.parent_cols, e.child_cols)])
        wanted = wanted.where(all_of(col(c).isNotNull() for c in wanted.columns)).distinct().withColumn(_mark(e), F.lit(True))
        rows = rows.join(wanted, all_of(col(c, CHILD) == col("_to_" + c) for c in e.child_cols), "left_outer")
        rows = rows.drop(*["_to_" + c for c in e.child_cols])
    return rows.where(any_of(col(_mark(e)).isNotNull() for e in arriving))


def _counts(met: DataFrame, edge: FkEdge) -> DataFrame:
    """Rows met through one foreign key, by its values."""
    return met.where(col(_mark(edge)).isNotNull()).groupBy(*[col(c, CHILD) for c in edge.child_cols]).agg(F.count("*").alias("n_rows"))


def _groups(frontier: DataFrame, edge: FkEdge, tables: Tables, counts: DataFrame, depth: int) -> DataFrame:
    """Child rows per frontier row. Children are counted per foreign-key value
    before the join, so a parent with very many children is one row there."""
    child = tables[edge.child]
    on = all_of(col(p, "ref_") == col(c, CHILD) for p, c in zip(edge.parent_cols, edge.child_cols))
    return frontier.join(counts, on).select(
        *ROOT,
        F.lit(depth).alias("depth"),
        F.lit(edge.parent).alias("parent_table"),
        F.col("row_key").alias("parent_key"),
        F.lit(edge.child).alias("child_table"),
        F.lit(",".join(edge.child_cols)).alias("fk_cols"),
        "n_rows",
        "n_paths",
        key_predicate(edge.child_cols, child.schema, lambda c: col(c, CHILD)).alias("predicate"),
        *[col(c, CHILD).alias("fk_" + c) for c in edge.child_cols],
    )


def _impact(groups: DataFrame, edge: FkEdge) -> DataFrame:
    return groups.drop(*["fk_" + c for c in edge.child_cols])


def _on_cycles(edges: Sequence[FkEdge]) -> set[str]:
    """Tables that foreign keys lead back to."""
    reach = defaultdict(set)
    for e in edges:
        reach[e.parent].add(e.child)
    grown = True
    while grown:
        grown = False
        for known in reach.values():
            more = set().union(*(reach.get(t, ()) for t in known)) - known
            if more:
                known |= more
                grown = True
    return {t for t, known in reach.items() if t in known}


def _followed(
    groups: DataFrame, edge: FkEdge, edges: Sequence[FkEdge], tables: Tables, keys: Keys, met: DataFrame, cap: int | None
) -> DataFrame:
    """Child rows of the groups small enough to follow."""
    if cap is not None:
        groups = groups.where(F.col("n_rows") <= cap)
    groups = groups.select(*ROOT, "n_paths", *[col(c, "fk_") for c in edge.child_cols])
    on = all_of(col(c, "fk_") == col(c, CHILD) for c in edge.child_cols)
    return met.where(col(_mark(edge)).isNotNull()).join(groups, on).select(
        *ROOT, "n_paths", *_frontier_columns(edge.child, edges, keys, tables, CHILD)
    )


def fk_impact(table: str, rows: DataFrame, edges: Sequence[FkEdge], tables: Tables, keys: Keys) -> DataFrame:
    """Per row of the table and foreign key on it: the number of child rows.
    Keys without children have no row."""
    start = _start(table, rows, edges, keys, tables)
    one = lambda e: _counts(_met(e.child, [e], {table: start}, tables, ()), e)
    return union_all([_impact(_groups(start, e, tables, one(e), 1), e) for e in edges if e.parent == table])


def fk_children(rows: DataFrame, edge: FkEdge, tables: Tables, keys: Keys, limit: int | None = None) -> DataFrame:
    """Child rows of the parent rows; with a limit the first rows per parent in key order."""
    parents = rows.select(*[col(c).alias("_p_" + c) for c in edge.parent_cols]).distinct()
    on = all_of(col(c) == col("_p_" + p) for c, p in zip(edge.child_cols, edge.parent_cols))
    children = tables[edge.child].join(parents, on, "left_semi")
    if limit is None:
        return children
    return first_per_class(children, edge.child_cols, _row(edge.child, keys, tables), limit)


def cascade_impact(
    roots: Tables,
    edges: Sequence[FkEdge],
    tables: Tables,
    keys: Keys,
    max_depth: int | None = None,
    expand_cap: int | None = None,
) -> DataFrame:
    """Child rows per root, parent row and foreign key, until nothing new is
    reached.

    ``roots`` maps tables to those of their rows that are looked into. Every
    group is counted in full. For a preview, ``max_depth`` ends the search
    and groups beyond ``expand_cap`` are not followed; ``followed`` is false
    for groups whose own children were left out so. ``n_paths`` is the number
    of ways in which the parent row is reached from the root. In tables that
    foreign keys lead back to, a row is followed once for each root.
    """
    frontier = {t: checkpointed(_start(t, rows, edges, keys, tables)) for t, rows in roots.items()}
    parents = {e.parent for e in edges}
    cyclic = _on_cycles(edges)
    seen = {t: checkpointed(frontier[t].select(*ROOT, "row_key")) for t in frontier if t in cyclic}
    impacts = []
    for depth in count(1):
        last = depth == max_depth
        reached, arriving = defaultdict(list), defaultdict(list)
        for e in edges:
            if e.parent in frontier:
                arriving[e.child].append(e)
        for table, through in arriving.items():
            follow = table in parents and not last
            columns = [*_row(table, keys, tables), *_references(table, edges)] if follow else ()
            met = _met(table, through, frontier, tables, columns)
            # Written once: counts and the next frontier come from it.
            if follow or len(through) > 1:
                met = checkpointed(met)
                counts = [_counts(met, e) for e in through]
            else:
                counts = [checkpointed(_counts(met, e)) for e in through]
            for e, counted in zip(through, counts):
                groups = _groups(frontier[e.parent], e, tables, counted, depth)
                kept = F.lit(True)
                if table in parents:
                    kept = F.lit(False) if last else kept if expand_cap is None else F.col("n_rows") <= expand_cap
                impacts.append(_impact(groups, e).withColumn("followed", kept))
                if follow:
                    reached[table].append(_followed(groups, e, edges, tables, keys, met, expand_cap))
        frontier = {}
        for table, frames in reached.items():
            rows = union_all(frames)
            if len(frames) > 1:
                rows = rows.groupBy(*[c for c in rows.columns if c != "n_paths"]).agg(F.sum("n_paths").alias("n_paths"))
            if table in seen:
                known = seen[table].toDF("_root_table", "_root_key", "_row_key")
                rows = rows.join(known, null_safe((c, "_" + c) for c in (*ROOT, "row_key")), "left_anti")
            rows = checkpointed(rows)
            if not rows.isEmpty():
                frontier[table] = rows
                if table in cyclic:
                    new = rows.select(*ROOT, "row_key")
                    seen[table] = seen[table].union(new) if table in seen else new
        if not frontier:
            break
    return union_all(impacts)


def cascade_rollup(impact: DataFrame) -> DataFrame:
    """Per root: direct (table, foreign key) groups and their rows, and the
    rows of all depths, counted once per path."""
    direct = F.col("depth") == 1
    rows = F.col("n_rows") * F.col("n_paths")
    return impact.groupBy(*ROOT).agg(
        F.countDistinct(F.when(direct, F.struct("child_table", "fk_cols"))).alias("affected_tables"),
        F.coalesce(F.sum(F.when(direct, rows)), F.lit(0)).cast("bigint").alias("affected_rows"),
        F.sum(rows).cast("bigint").alias("total_rows"),
    ).withColumn("cascade", F.concat("affected_tables", F.lit("t × "), "affected_rows", F.lit("r")))


def cascade_groups(impact: DataFrame) -> DataFrame:
    """Per root and (parent table, child table, foreign key): rows at each depth."""
    return impact.groupBy(*ROOT, "depth", "parent_table", "child_table", "fk_cols").agg(
        F.sum(F.col("n_rows") * F.col("n_paths")).cast("bigint").alias("n_rows")
    )


def cascade_delete_plan(impact: DataFrame, roots: Tables, keys: Keys, schema: str = "public") -> DataFrame:
    """One delete per group of child rows and per root, ``step`` ascending:
    deepest children first, the root last. An impact that left out children
    is refused, since its plan would be incomplete."""
    if not impact.where("NOT followed").isEmpty():
        raise ValueError("the impact has groups that were not followed; take one without max_depth and expand_cap")
    text = lambda table, where: F.concat(F.lit("DELETE FROM "), F.lit(schema + "."), table, F.lit(" WHERE "), where, F.lit(";"))
    child = F.concat(F.lit('"'), F.replace("child_table", F.lit('"'), F.lit('""')), F.lit('"'))
    children = (
        impact.groupBy(*ROOT, "child_table", "predicate").agg((-F.max("depth")).alias("step"))
        .select(*ROOT, "step", F.col("child_table").alias("table_name"), text(child, F.col("predicate")).alias("statement"))
    )
    parts = [children]
    for table, rows in roots.items():
        where = key_predicate(keys[table], rows.schema)
        parts.append(
            rows.select(
                F.lit(table).alias("root_table"), json_image(keys[table]).alias("root_key"), F.lit(0).alias("step"),
                F.lit(table).alias("table_name"), text(F.lit(sql_name(table)), where).alias("statement"),
            )
        )
    return union_all(parts)


def cascade_rows(roots: Tables, edges: Sequence[FkEdge], tables: Tables, keys: Keys) -> dict[str, DataFrame]:
    """Every row that goes when the roots go, once: per table its key columns
    and the columns foreign keys point at. Tables are taken parents first, in
    one pass; tables that refer to each other are followed until nothing new
    is found."""
    def columns(table: str) -> list[Column]:
        return [col(c) for c in dict.fromkeys([*_row(table, keys, tables), *_references(table, edges)])]

    def children(e: FkEdge, parents: DataFrame) -> DataFrame:
        hit = parents.select(*[col(c).alias("_p_" + c) for c in e.parent_cols]).distinct()
        on = all_of(col(c) == col("_p_" + p) for c, p in zip(e.child_cols, e.parent_cols))
        return tables[e.child].join(hit, on, "left_semi").select(*columns(e.child))

    edges = [e for e in edges if e.child in tables and e.parent in tables]
    levels = table_levels(tables, edges)
    found = {t: rows.select(*columns(t)) for t, rows in roots.items()}
    if any(e.child == e.parent or levels[e.child] <= levels[e.parent] for e in edges):
        return _closure(found, edges, children, {t: _row(t, keys, tables) for t in tables})
    parents = {e.parent for e in edges}
    for table in sorted(tables, key=lambda t: (levels[t], t)):
        parts = [found[table]] if table in found else []
        parts += [children(e, found[e.parent]) for e in edges if e.child == table and e.parent in found]
        if parts:
            rows = union_all(parts).distinct() if len(parts) > 1 else parts[0]
            found[table] = checkpointed(rows) if table in parents else rows
    return found


def _closure(delta: dict[str, DataFrame], edges, children, row: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    seen = {t: checkpointed(rows.distinct()) for t, rows in delta.items()}
    delta = dict(seen)
    while delta:
        reached = defaultdict(list)
        for e in edges:
            if e.parent in delta:
                reached[e.child].append(children(e, delta[e.parent]))
        delta = {}
        for table, frames in reached.items():
            rows = union_all(frames).distinct()
            if table in seen:
                known = seen[table].select(*[col(c).alias("_s_" + c) for c in row[table]])
                rows = rows.join(known, null_safe((c, "_s_" + c) for c in row[table]), "left_anti")
            rows = checkpointed(rows)
            if not rows.isEmpty():
                delta[table] = rows
                seen[table] = seen[table].unionByName(rows) if table in seen else rows
    return seen


def purge(tables: Tables, doomed: Tables, keys: Keys) -> dict[str, DataFrame]:
    """The tables without the doomed rows."""
    left = {}
    for table, df in tables.items():
        if table in doomed:
            names = _row(table, keys, tables)
            gone = doomed[table].select(*[col(c).alias("_d_" + c) for c in names])
            df = df.join(gone, null_safe((c, "_d_" + c) for c in names), "left_anti")
        left[table] = df
    return left
