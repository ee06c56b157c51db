"""From keywords to the records they find and all that hangs on those."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.columns import any_of, col
from tidemark.functions.text import any_keyword, preview
from tidemark.operators.cascade import cascade_impact, cascade_rollup
from tidemark.operators.edges import FkEdge
from tidemark.operators.scan import DEFAULT_KEYWORDS, data_scope, found_records, text_columns


@dataclass(frozen=True)
class JunkReport:
    """records: one row per record found; impact: `cascade_impact` of them;
    report: records with their cascade."""

    records: DataFrame
    impact: DataFrame | None
    report: DataFrame


def matching_rows(df: DataFrame, keywords: Sequence[str], match: str = "substring") -> DataFrame:
    """Rows of which a text column holds a keyword."""
    return df.where(any_of(any_keyword(col(c), keywords, match) for c in text_columns(df)))


def junk_report(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    edges: Sequence[FkEdge],
    all_tables: Mapping[str, DataFrame],
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    match: str = "substring",
    max_depth: int | None = None,
    expand_cap: int | None = None,
    schemas: Mapping[str, str] | None = None,
    scopes: DataFrame | None = None,
) -> JunkReport:
    """Scan ``tables`` and follow the records found through ``all_tables``.

    Every table is read once for the scan and, where foreign keys point at
    it, once more for the rows to follow; hits are not joined back. ``scopes``
    selects the tables to scan by their schema, as in `scan_records`; the
    cascade goes wherever foreign keys lead.
    """
    records = found_records(tables, keys, keywords, match, schemas, scopes)
    if scopes is not None:
        tables = data_scope(tables, schemas or {}, scopes)
    parents = {e.parent for e in edges}
    roots = {t: matching_rows(df, keywords, match) for t, df in tables.items() if t in parents and keys.get(t)}
    impact = cascade_impact(roots, edges, all_tables, keys, max_depth, expand_cap) if roots else None
    shown = records.select(
        "table_name", "no_key", "key", "keyword", F.array_join("columns", ", ").alias("columns"),
        preview(F.col("content")).alias("preview"),
    )
    if impact is None:
        return JunkReport(records, None, shown.withColumn("cascade", F.lit("— none")))
    rollup = cascade_rollup(impact).select(
        F.col("root_table").alias("table_name"), F.col("root_key").alias("key"), "cascade"
    )
    report = shown.join(rollup, ["table_name", "key"], "left_outer").withColumn(
        "cascade", F.coalesce("cascade", F.lit("— none"))
    )
    return JunkReport(records, impact, report)
