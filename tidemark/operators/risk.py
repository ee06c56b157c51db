"""Checks of a change set before it is applied.

The limits are parameters; each check is a count a reviewer can act on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import all_of, col, lower_set
from tidemark.functions.secrets import is_secret, is_secret_name
from tidemark.operators.config import dotted, json_leaves, parse_env
from tidemark.operators.diff import CompareOptions, image_type, row_diffs
from tidemark.operators.edges import FkEdge
from tidemark.operators.keys import union_all
from tidemark.session import checkpointed

# Names and values that stand for a development setting.
DEBUG_WORDS = ("debug", "development")


def _cells(diff: DataFrame, keys: Sequence[str]) -> dict[tuple[str, str], Column]:
    """Per column: secrets that would be written, values that become null."""
    src, tgt = image_type(diff, "source").fieldNames(), image_type(diff, "target").fieldNames()
    new, old = (lambda c: F.col("source").getField(c)), (lambda c: F.col("target").getField(c))
    updated = lambda c: (F.col("op") == "U") & F.array_contains("changed_columns", c)
    tests: dict[tuple[str, str], Column] = {}
    for c in src:
        if c in keys:
            continue
        if is_secret_name(c):
            filled = F.coalesce(new(c).cast("string") != "", F.lit(False))
            tests["sensitive_value", c] = ((F.col("op") == "I") | updated(c)) & filled
        if c in tgt:
            tests["unusual_null", c] = updated(c) & new(c).isNull() & old(c).isNotNull()
    return tests


def _row_checks(table: str, slim: DataFrame, cells: Sequence[tuple[str, str]], max_share: float) -> DataFrame:
    """All counts of a table in one aggregation."""
    n = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0)).cast("bigint")
    op = F.col("op")
    counts = slim.agg(
        n(op == "D").alias("deletes"), n(op == "U").alias("updates"), n(op != "I").alias("rows"),
        *[n(F.col(f"cell{i}")).alias(f"cell{i}") for i in range(len(cells))],
    )

    def entry(check: str, detail: str, rows: str, limit: float, flagged: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"), F.lit(detail).alias("detail"), F.col(rows).alias("n_rows"),
            F.lit(float(limit)).alias("limit"), flagged.alias("flagged"),
        )

    share = lambda rows: F.col(rows) > F.col("rows") * max_share
    entries = [
        entry("bulk_delete", "", "deletes", max_share, share("deletes")),
        entry("bulk_update", "", "updates", max_share, share("updates")),
        *[entry(check, c, f"cell{i}", 0, F.col(f"cell{i}") > 0) for i, (check, c) in enumerate(cells)],
    ]
    return counts.select(F.lit(table).alias("table_name"), F.inline(F.array(*entries)))


def orphans(child: DataFrame, parent: DataFrame, edge: FkEdge) -> DataFrame:
    """Child rows whose foreign key is set and points at no parent row."""
    keys = parent.select(*[col(c).alias("_p_" + c) for c in edge.parent_cols]).distinct()
    on = all_of(col(c) == col("_p_" + p) for c, p in zip(edge.child_cols, edge.parent_cols))
    return child.where(all_of(col(c).isNotNull() for c in edge.child_cols)).join(keys, on, "left_anti")


def change_risk(
    src_tables: Mapping[str, DataFrame],
    tgt_tables: Mapping[str, DataFrame],
    keys_by_table: Mapping[str, Sequence[str]],
    edges: Sequence[FkEdge] = (),
    options: CompareOptions = CompareOptions(),
    max_share: float = 0.2,
) -> DataFrame:
    """Checks of the changes that turn the target into the source, per table:
    bulk_delete and bulk_update (share of the target's rows), orphan (rows
    without parent afterwards), sensitive_value and unusual_null."""
    diffs = row_diffs(src_tables, tgt_tables, keys_by_table, options)
    edges = [e for e in edges if e.child in diffs and e.parent in diffs]
    checks, after = [], {}
    for table, diff in diffs.items():
        # Every diff is run once, down to what the checks below ask for.
        keys, cells = keys_by_table[table], _cells(diff, keys_by_table[table])
        linked = {c for e in edges for t, cols in ((e.child, e.child_cols), (e.parent, e.parent_cols)) if t == table for c in cols}
        slim = checkpointed(
            diff.select(
                "op",
                *[test.alias(f"cell{i}") for i, test in enumerate(cells.values())],
                *[_value_after(diff, c, keys, options.ignore).alias("after_" + c) for c in sorted(linked)],
            )
        )
        checks.append(_row_checks(table, slim, list(cells), max_share))
        after[table] = slim.where("op <> 'D'").select(*[col("after_" + c).alias(c) for c in sorted(linked)])
    for e in edges:
        lost = orphans(after[e.child], after[e.parent], e).agg(F.count("*").alias("n_rows"))
        checks.append(
            lost.select(
                F.lit(e.child).alias("table_name"), F.lit("orphan").alias("check"),
                F.lit(f"{','.join(e.child_cols)} -> {e.parent}").alias("detail"), "n_rows",
                F.lit(0.0).alias("limit"), (F.col("n_rows") > 0).alias("flagged"),
            )
        )
    return union_all(checks)


def _value_after(diff: DataFrame, c: str, keys: Sequence[str], ignore: Sequence[str]) -> Column:
    """Value of a target column once the changes are applied."""
    if c in keys:
        return col(c)
    new, old = F.col("source").getField(c), F.col("target").getField(c)
    if c.lower() in lower_set(ignore):
        new = F.lit(None)
    written = (F.col("op") == "I") | ((F.col("op") == "U") & F.array_contains("changed_columns", c))
    return F.when(written, new).otherwise(old)


def schema_risk(table_changes: DataFrame, column_changes: DataFrame) -> DataFrame:
    """Dropped tables, dropped columns, and new NOT NULL columns without
    default, from `table_diff` and `column_diff`."""
    place = ("database", "schema", "table_name")
    tables = table_changes.where("diff_type = 'ExistingInTarget'").select(
        *place, F.lit("").alias("column_name"), F.lit("dropped_table").alias("risk")
    )
    risk = F.when(F.col("change") == "DROP", "dropped_column").when(
        (F.col("change") == "ADD") & ~F.col("new_nullable") & (F.coalesce("new_default", F.lit("")) == ""),
        "not_null_without_default",
    )
    columns = column_changes.select(*place, "column_name", risk.alias("risk")).where("risk IS NOT NULL")
    return tables.unionByName(columns)


def config_risk(files: DataFrame) -> DataFrame:
    """Secrets with a value, and debug or development settings that are on, in
    a tree of .json and .env files (path, content): (path, item, risk)."""
    trees = files.where(F.col("path").endswith(".json")).withColumnRenamed("path", "file")
    leaves = json_leaves(trees, "file", "content", into_arrays=True).select(
        F.col("file").alias("path"), dotted(F.col("path")).alias("item"),
        F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("")).alias("name"),
        F.when(F.col("type").isin("string", "boolean", "number"), F.col("value")).otherwise("").alias("value"),
    )
    env_lines = files.where(F.col("path").endswith(".env")).select(
        "path", F.posexplode(F.split("content", "\r\n|\r|\n")).alias("line_no", "line")
    )
    env = parse_env(env_lines, "path").select("path", F.col("key").alias("item"), F.col("key").alias("name"), "value")
    items = leaves.unionByName(env)
    name, value = F.lower("name"), F.lower("value")
    secret = is_secret(F.col("name")) & (F.col("value") != "")
    debug = (name.rlike(DEBUG_WORDS[0]) & value.isin("true", "1", "on", "yes")) | value.isin(*DEBUG_WORDS)
    risk = F.when(secret, "secret_value").when(debug, "debug_setting")
    return items.select("path", "item", risk.alias("risk")).where("risk IS NOT NULL")

