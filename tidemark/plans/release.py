"""One comparison of a release, used for everything that follows from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.diff import CompareOptions, diff_detail, row_diffs, summarize
from tidemark.operators.edges import FkEdge
from tidemark.operators.keys import union_all
from tidemark.operators.sync import apply_changes, feed_of
from tidemark.session import checkpointed


@dataclass(frozen=True)
class Release:
    """Row diffs of a release, each written once."""

    diffs: Mapping[str, DataFrame]
    keys: Mapping[str, Sequence[str]]
    options: CompareOptions

    def summary(self) -> DataFrame:
        """Counts and status per table."""
        status = F.when(F.col("has_differences"), F.lit("Different")).otherwise(F.lit("Synchronized"))
        return union_all(
            [summarize(d).select(F.lit(t).alias("table_name"), "*", status.alias("status")) for t, d in self.diffs.items()]
        )

    def detail(self, table: str, limit_per_class: int | None = None) -> DataFrame:
        return diff_detail(self.diffs[table], self.keys[table], limit_per_class)

    def feed(self, edges: Sequence[FkEdge], schema: str = "public", upsert: bool = False) -> DataFrame:
        return feed_of(self.diffs, self.keys, edges, schema, self.options.ignore, upsert)

    def applied(self, table: str, tgt: DataFrame, mode: str = "update") -> DataFrame:
        """The table of the target after the release."""
        return apply_changes(tgt, self.diffs[table], self.keys[table], mode, self.options.ignore, where=self.options.where)


def compare_release(
    src_tables: Mapping[str, DataFrame],
    tgt_tables: Mapping[str, DataFrame],
    keys_by_table: Mapping[str, Sequence[str]],
    options: CompareOptions = CompareOptions(),
) -> Release:
    """Compare all keyed tables of two snapshots once. Summary, detail, feed
    and the resulting tables are then read from the written diffs, each with
    no more columns than it needs."""
    diffs = row_diffs(src_tables, tgt_tables, keys_by_table, options)
    return Release({t: checkpointed(d) for t, d in diffs.items()}, keys_by_table, options)
