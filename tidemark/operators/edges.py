"""Foreign-key edges and parent-first table ranks.

Edges between tables are metadata: a list as long as the number of foreign
keys. Graphs over rows or catalog objects are DataFrames, see graph.py.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class FkEdge:
    child: str
    child_cols: tuple[str, ...]
    parent: str
    parent_cols: tuple[str, ...]


def fk_edges(constraints: DataFrame) -> DataFrame:
    """Distinct edges per database from one row per constraint column
    (database, constraint_name, position, child, child_col, parent, parent_col)."""
    columns = F.sort_array(F.collect_list(F.struct("position", "child_col", "parent_col")))
    return (
        constraints.groupBy("database", "constraint_name", "child", "parent")
        .agg(columns.alias("_c"))
        .select(
            "database", "child", F.col("_c.child_col").alias("child_cols"),
            "parent", F.col("_c.parent_col").alias("parent_cols"),
        )
        .distinct()
    )


def edges_from_frame(edges: DataFrame) -> list[FkEdge]:
    """The edges of one database, as the table operators take them."""
    rows = edges.select("child", "child_cols", "parent", "parent_cols").collect()
    return [FkEdge(r.child, tuple(r.child_cols), r.parent, tuple(r.parent_cols)) for r in rows]


def table_levels(tables: Iterable[str], edges: Sequence[FkEdge]) -> dict[str, int]:
    """Parent-first rank of a few tables; those on or behind a cycle share
    the rank after the last. Only edges inside the set count."""
    left = set(tables)
    parents = {t: {e.parent for e in edges if e.child == t and e.parent in left and e.parent != t} for t in left}
    levels: dict[str, int] = {}
    rank = 0
    while left:
        ready = {t for t in left if not parents[t] & left} or left
        levels.update(dict.fromkeys(ready, rank))
        left = left - ready
        rank += 1
    return levels
