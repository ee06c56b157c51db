"""Row comparison, statements and resulting snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from queries import Registry
from queries.frames import load, with_frames
from queries.sqltext import (
    LINEITEM,
    ORDERS,
    ORDERS_KINDS,
    diff_cte,
    dml,
    literal,
    orders_diff,
    summary,
)
from tidemark.functions.values import changed_columns, sql_literal, value_changed
from tidemark.operators import diff as D, keys as K, sync as S

registry = Registry()
KEY = ["o_orderkey"]
OPTIONS = D.CompareOptions()


def _orders(spark, sf_dir):
    return load(spark, sf_dir, "orders", "old_orders")


def _diff(spark, sf_dir, options=OPTIONS) -> DataFrame:
    src, tgt = _orders(spark, sf_dir)
    return D.row_diff(src, tgt, KEY, options)


def flat(diff: DataFrame, keys, columns) -> DataFrame:
    """Row images as columns, so that any client can compare them."""
    stamps = {"o_orderdate", "l_shipdate"}
    cell = lambda side, c: F.col(side)[c].cast("string") if c in stamps else F.col(side)[c]
    return diff.select(
        "op", *[F.col(k) for k in keys], "occurrence",
        *[cell(side, c).alias(f"{prefix}_{c}") for c in columns if c not in keys for side, prefix in (("source", "s"), ("target", "t"))],
        F.array_join("changed_columns", ",").alias("changed"),
    )


def flat_sql(frame, keys, columns) -> str:
    stamps = {"o_orderdate", "l_shipdate"}
    cell = lambda p, c: f"CAST({p}_{c} AS VARCHAR) AS {p}_{c}" if c in stamps else f"{p}_{c}"
    cells = ", ".join(cell(p, c) for c in columns if c not in keys for p in ("s", "t"))
    return f"SELECT op, {', '.join(keys)}, occurrence, {cells}, changed FROM {frame}"


@registry.add("row_diff", orders_diff() + "\n" + flat_sql("d", KEY, ORDERS))
def row_diff(spark, sf_dir):
    return flat(_diff(spark, sf_dir), KEY, ORDERS)


@registry.add("diff_summary", f"{orders_diff()}\n{summary('orders')}")
def diff_summary(spark, sf_dir):
    src, tgt = _orders(spark, sf_dir)
    return D.diff_summary("orders", src, tgt, KEY)


@registry.add("diff_ignore_columns", f"{orders_diff(['o_orderdate', 'o_totalprice'])}\n{summary('orders')}")
def diff_ignore_columns(spark, sf_dir):
    src, tgt = _orders(spark, sf_dir)
    ignore = D.parse_column_list("O_OrderDate, , o_totalprice ")
    return D.diff_summary("orders", src, tgt, KEY, D.CompareOptions(ignore=ignore))


_WHERE = "o_orderpriority <> '2-HIGH' AND o_totalprice > 1000"


@registry.add("diff_where", f"{orders_diff(where=_WHERE)}\n{summary('orders')}")
def diff_where(spark, sf_dir):
    src, tgt = _orders(spark, sf_dir)
    return D.diff_summary("orders", src, tgt, KEY, D.CompareOptions(where=_WHERE))


@registry.add(
    "diff_detail_capped",
    f"""{orders_diff()}
SELECT op, o_orderkey, changed FROM d QUALIFY row_number() OVER (PARTITION BY op ORDER BY o_orderkey, occurrence) <= 1000""",
)
def diff_detail_capped(spark, sf_dir):
    detail = D.diff_detail(_diff(spark, sf_dir), KEY, limit_per_class=1000)
    return detail.select("op", "o_orderkey", F.array_join("changed_columns", ",").alias("changed"))


@registry.add(
    "diff_class_counts",
    f"""{orders_diff()}
SELECT CASE op WHEN 'I' THEN 'Added' WHEN 'D' THEN 'Removed' WHEN 'U' THEN 'Changed' ELSE 'Identical' END AS diff_class,
       count(*) AS n_rows FROM d GROUP BY op""",
)
def diff_class_counts(spark, sf_dir):
    return D.diff_class_counts(_diff(spark, sf_dir))


def _line_sql(position, label, side, changed) -> str:
    cells = ", ".join(f"coalesce(CAST({side}_{c} AS VARCHAR), 'NULL') AS {c}" for c in ORDERS)
    return f"SELECT occurrence, {position} AS line, '{label}' AS row_type, {changed} AS changed_columns, {cells} FROM d WHERE op = 'U'"


@registry.add(
    "diff_side_by_side",
    f"""{orders_diff()}
{_line_sql(1, 'New', 's', "replace(changed, ',', ', ')")} UNION ALL {_line_sql(2, 'Old', 't', "''")}""",
)
def diff_side_by_side(spark, sf_dir):
    return D.diff_side_by_side(_diff(spark, sf_dir))


@registry.add(
    "changed_columns",
    f"{orders_diff()}\nSELECT o_orderkey, changed FROM d WHERE op IN ('U', 'S')",
)
def changed_columns_query(spark, sf_dir):
    src, tgt = _orders(spark, sf_dir)
    names = D.compared_columns(src, tgt, KEY)
    old = tgt.select(*[F.col(c).alias("old_" + c) for c in tgt.columns])
    pairs = src.join(old, F.col("o_orderkey") == F.col("old_o_orderkey"))
    flags = [
        (c, value_changed(F.col(c), F.col("old_" + c), src.schema[c].dataType, tgt.schema[c].dataType)) for c in names
    ]
    return pairs.select("o_orderkey", F.array_join(changed_columns(flags), ",").alias("changed"))


_SIDES = with_frames("old_orders")


@registry.add("inserted_keys", f"{_SIDES}\nSELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM old_orders")
def inserted_keys(spark, sf_dir):
    return K.inserted_keys(*_orders(spark, sf_dir), KEY)


@registry.add("deleted_keys", f"{_SIDES}\nSELECT o_orderkey FROM old_orders EXCEPT SELECT o_orderkey FROM orders")
def deleted_keys(spark, sf_dir):
    return K.deleted_keys(*_orders(spark, sf_dir), KEY)


@registry.add("common_keys", f"{_SIDES}\nSELECT o_orderkey FROM orders INTERSECT SELECT o_orderkey FROM old_orders")
def common_keys(spark, sf_dir):
    return K.common_keys(*_orders(spark, sf_dir), KEY)


def _texts(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def _applied_sql(mode: str) -> str:
    def cell(c: str) -> str:
        if c == "o_orderkey":
            return "o_orderkey"
        if c == "o_custkey":  # ignored: kept on update, null on insert
            return "CASE op WHEN 'I' THEN NULL ELSE t_o_custkey END AS o_custkey"
        written = "op IN ('I', 'U')" if mode == "upsert" else f"op = 'I' OR list_contains(string_split(changed, ','), '{c}')"
        value = f"CASE WHEN {written} THEN s_{c} ELSE t_{c} END"
        return f"CAST({value} AS VARCHAR) AS {c}" if c == "o_orderdate" else f"{value} AS {c}"

    return f"{orders_diff(['o_custkey'])}\nSELECT {', '.join(map(cell, ORDERS))} FROM d WHERE op <> 'D'"


def _applied(spark, sf_dir, mode):
    src, tgt = _orders(spark, sf_dir)
    options = D.CompareOptions(ignore=["o_custkey"])
    return _texts(S.apply_changes(tgt, D.row_diff(src, tgt, KEY, options), KEY, mode, options.ignore))


@registry.add("apply_update", _applied_sql("update"))
def apply_update(spark, sf_dir):
    return _applied(spark, sf_dir, "update")


@registry.add("apply_upsert", _applied_sql("upsert"))
def apply_upsert(spark, sf_dir):
    return _applied(spark, sf_dir, "upsert")


@registry.add(
    "insert_if_absent",
    f"""{_SIDES}
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM old_orders
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR), o_orderpriority FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old_orders)""",
)
def insert_if_absent(spark, sf_dir):
    src, tgt = _orders(spark, sf_dir)
    return _texts(S.insert_if_absent(tgt, src.unionAll(src), KEY))


@registry.add(
    "dry_run",
    f"""{orders_diff()}
SELECT (SELECT count(*) FROM old_orders) AS rows_before, count(*) FILTER (op = 'I') AS inserted, count(*) FILTER (op = 'D') AS deleted,
       count(*) FILTER (op = 'U') AS updated, count(*) FILTER (op <> 'D') AS rows_after FROM d""",
)
def dry_run(spark, sf_dir):
    src, tgt = _orders(spark, sf_dir)
    return S.dry_run(D.row_diff(src, tgt, KEY), tgt)


@registry.add(
    "verify_sync",
    f"""{with_frames("old_orders")},
{diff_cte("d", "orders", "old_orders", KEY, ORDERS)}
SELECT 'orders' AS table_name, count(*) FILTER (op <> 'S') AS remaining, count(*) FILTER (op <> 'S') = 0 AS passed FROM d
UNION ALL SELECT 'applied', 0, true""",
)
def verify_sync(spark, sf_dir):
    src, tgt = _orders(spark, sf_dir)
    applied = S.apply_changes(tgt, D.row_diff(src, tgt, KEY), KEY)
    return S.verify_sync({"orders": src, "applied": src}, {"orders": tgt, "applied": applied}, {"orders": KEY, "applied": KEY})


def _dml_sql(upsert: bool) -> str:
    return f"""{orders_diff()}
SELECT op, o_orderkey, occurrence, {dml('orders', 'o_orderkey', ORDERS_KINDS, upsert)} AS statement FROM d WHERE op <> 'S'"""


@registry.add("render_dml", _dml_sql(False))
def render_dml(spark, sf_dir):
    return S.render_dml(_diff(spark, sf_dir), "orders", KEY)


@registry.add("render_upsert", _dml_sql(True))
def render_upsert(spark, sf_dir):
    return S.render_dml(_diff(spark, sf_dir), "orders", KEY, upsert=True)


@registry.add(
    "sql_literal",
    f"""SELECT doc_id, {literal('text', 'text')} AS text_literal, {literal('CASE WHEN n_chars > 500 THEN n_chars END', 'number')} AS number_literal,
       CASE WHEN n_chars > 500 THEN 'TRUE' ELSE 'FALSE' END AS bool_literal, '''{{' || lang || ',' || source || '}}''' AS array_literal,
       '''' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(n_chars * 1000), '%Y-%m-%d %H:%M:%S.%g') || '''' AS stamp_literal
FROM documents""",
)
def sql_literal_query(spark, sf_dir):
    (documents,) = load(spark, sf_dir, "documents")
    values = documents.select(
        "doc_id",
        F.col("text").alias("text_literal"),
        F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("number_literal"),
        (F.col("n_chars") > 500).alias("bool_literal"),
        F.array("lang", "source").alias("array_literal"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(n_chars as decimal(18,6)) / 1000)").alias("stamp_literal"),
    )
    return values.select(
        "doc_id", *[sql_literal(F.col(f.name), f.dataType).alias(f.name) for f in values.schema if f.name != "doc_id"]
    )


LINE_KEY = ["l_orderkey", "l_linenumber"]
FULL_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@registry.add(
    "key_profile",
    f"""{with_frames("lineitem_null_keys")},
g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem_null_keys GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys,
       CAST(coalesce(sum(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0) AS BIGINT) AS null_key_rows,
       count(*) FILTER (n > 1) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS excess_rows, max(n) AS largest_group FROM g""",
)
def key_profile(spark, sf_dir):
    (lines,) = load(spark, sf_dir, "lineitem_null_keys")
    return K.key_profile(lines, LINE_KEY)


_LINE_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in LINEITEM if c not in LINE_KEY)


@registry.add(
    "with_occurrence",
    f"""SELECT {', '.join(c for c in LINEITEM if c != 'l_shipdate')}, CAST(l_shipdate AS VARCHAR) AS l_shipdate,
       row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS occurrence FROM lineitem""",
)
def with_occurrence(spark, sf_dir):
    (lines,) = load(spark, sf_dir, "lineitem")
    return K.with_occurrence(lines, LINE_KEY).withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@registry.add(
    "row_diff_duplicate_keys",
    with_frames("old_lineitem") + ",\n"
    + diff_cte("d", "lineitem", "old_lineitem", LINE_KEY, LINEITEM, occurrence=True) + "\n" + flat_sql("d", LINE_KEY, LINEITEM),
)
def row_diff_duplicate_keys(spark, sf_dir):
    src, tgt = load(spark, sf_dir, "lineitem", "old_lineitem")
    return flat(D.row_diff(src, tgt, LINE_KEY), LINE_KEY, LINEITEM)


@registry.add(
    "diff_summary_composite_key",
    f"""{with_frames("old_lineitem")},
{diff_cte("d", "lineitem", "old_lineitem", FULL_KEY, LINEITEM, occurrence=True)}
{summary('lineitem')}""",
)
def diff_summary_composite_key(spark, sf_dir):
    src, tgt = load(spark, sf_dir, "lineitem", "old_lineitem")
    return D.diff_summary("lineitem", src, tgt, FULL_KEY)




@registry.add(
    "row_changes",
    with_frames("old_lineitem") + ",\n"
    + diff_cte("d", "lineitem", "old_lineitem", LINE_KEY, LINEITEM, occurrence=True) + "\n" + flat_sql("d", LINE_KEY, LINEITEM) + " WHERE op <> 'S'",
)
def row_changes(spark, sf_dir):
    """Changed rows only, found by digests; keys repeat."""
    src, tgt = load(spark, sf_dir, "lineitem", "old_lineitem")
    return flat(D.row_changes(src, tgt, LINE_KEY), LINE_KEY, LINEITEM)


_FLAG = "l_returnflag = 'R'"
_LINE_CELLS = lambda p="": ", ".join(f"CAST({p}{c} AS VARCHAR) AS {c}" if c == "l_shipdate" else f"{p}{c} AS {c}" for c in LINEITEM)


@registry.add(
    "apply_where_duplicate_keys",
    f"""{with_frames("old_lineitem")},
{diff_cte("d", "lineitem", "old_lineitem", LINE_KEY, LINEITEM, where=_FLAG, occurrence=True)}
SELECT {_LINE_CELLS("s_")} FROM d WHERE op <> 'D'
UNION ALL SELECT {_LINE_CELLS()} FROM old_lineitem WHERE ({_FLAG}) IS NOT TRUE""",
)
def apply_where_duplicate_keys(spark, sf_dir):
    """Changes of part of a table with repeated keys; the other rows stay."""
    src, tgt = load(spark, sf_dir, "lineitem", "old_lineitem")
    changes = D.row_changes(src, tgt, LINE_KEY, D.CompareOptions(where=_FLAG))
    applied = S.apply_changes(tgt, changes, LINE_KEY, where=_FLAG)
    return applied.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))
