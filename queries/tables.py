"""Several tables at once: summaries, feed, inventory, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import Registry
from queries.frames import load, with_frames
from queries.sqltext import CUSTOMER, CUSTOMER_KINDS, ORDERS, ORDERS_KINDS, PART, diff_cte, dml, summary
from tidemark.operators import diff as D, inventory as I, risk as R, sync as S
from tidemark.operators.edges import FkEdge
from tidemark.operators.keys import union_all
from tidemark.plans.release import compare_release
from tidemark.session import checkpointed

registry = Registry()
KEYS = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "part": ["p_partkey"], "supplier": []}
EDGE = FkEdge("orders", ("o_custkey",), "customer", ("c_custkey",))


def _sides(spark, sf_dir):
    names = list(KEYS)
    src = load(spark, sf_dir, *names)
    tgt = load(spark, sf_dir, *["old_" + n for n in names])
    return dict(zip(names, src)), dict(zip(names, tgt))


_DIFFS = (
    with_frames("old_customer", "old_orders", "old_part", "old_supplier") + ",\n"
    + diff_cte("dc", "customer", "old_customer", ["c_custkey"], CUSTOMER) + ",\n"
    + diff_cte("dor", "orders", "old_orders", ["o_orderkey"], ORDERS) + ",\n"
    + diff_cte("dp", "part", "old_part", ["p_partkey"], PART)
)
_SUMMARIES = f"""{summary('customer', 'dc')} UNION ALL {summary('orders', 'dor')} UNION ALL {summary('part', 'dp')}
UNION ALL SELECT 'supplier', 0, 0, 0, 0, 0, false, 'no_key'"""


@registry.add("diff_summary_all", f"{_DIFFS}\n{_SUMMARIES}")
def diff_summary_all(spark, sf_dir):
    return D.diff_summary_all(*_sides(spark, sf_dir), KEYS)


def _json(prefix: str, kinds: dict[str, str], op_without: str) -> str:
    """Row image as JSON text, null where the row is not on that side."""
    def cell(c: str, kind: str) -> str:
        v = f"{prefix}_{c}"
        text = {
            "number": f"CAST({v} AS VARCHAR)",
            "text": f"'\"' || {v} || '\"'",
            "stamp": f"'\"' || strftime({v}, '%Y-%m-%dT%H:%M:%S.%f') || '\"'",
        }[kind]
        return f"'\"{c}\":' || coalesce({text}, 'null')"

    return f"CASE WHEN op <> '{op_without}' THEN '{{' || " + " || ',' || ".join(cell(c, k) for c, k in kinds.items()) + " || '}' END"


def _feed_sql(frame: str, table: str, key: str, kinds: dict[str, str], level: int) -> str:
    return f"""SELECT CASE op WHEN 'D' THEN 1 ELSE 2 END AS phase, CASE op WHEN 'D' THEN {-level} ELSE {level} END AS level,
       '{table}' AS table_name, CASE op WHEN 'U' THEN 2 ELSE 1 END AS op_rank, op, '{{"{key}":' || {key} || '}}' AS key, occurrence,
       {_json('t', kinds, 'I')} AS before, {_json('s', kinds, 'D')} AS after, changed AS changed_columns,
       {dml(table, key, kinds)} AS statement
FROM {frame} WHERE op <> 'S'"""


def _feed(spark, sf_dir):
    src, tgt = _sides(spark, sf_dir)
    return S.change_feed(src, tgt, KEYS, [EDGE])


@registry.add(
    "change_feed",
    f"""{_DIFFS}
{_feed_sql('dc', 'customer', 'c_custkey', CUSTOMER_KINDS, 0)} UNION ALL {_feed_sql('dor', 'orders', 'o_orderkey', ORDERS_KINDS, 1)}""",
)
def change_feed(spark, sf_dir):
    return S.ordered_feed(_feed(spark, sf_dir)).withColumn("changed_columns", F.array_join("changed_columns", ","))


@registry.add(
    "apply_feed",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, 'S' AS after_apply, count(*) AS n_rows FROM {t}" for t in ("customer", "orders", "part")),
)
def apply_feed(spark, sf_dir):
    """The feed of all keyed tables read back, applied, and compared with the source again."""
    src, tgt = _sides(spark, sf_dir)
    feed = checkpointed(S.change_feed(src, tgt, KEYS, [EDGE]))

    def left(table):
        changes = S.feed_changes(feed, table, src[table], tgt[table], KEYS[table])
        applied = S.apply_changes(tgt[table], changes, KEYS[table])
        diff = D.row_diff(src[table], applied, KEYS[table])
        return diff.groupBy(F.lit(table).alias("table_name"), F.col("op").alias("after_apply")).agg(F.count("*").alias("n_rows"))

    return union_all([left(t) for t in sorted(KEYS) if KEYS[t]])


def _inventory(spark, sf_dir, with_summaries=False):
    customer, orders, part, events, supplier = load(spark, sf_dir, "customer", "orders", "part", "events", "supplier")
    old_customer, old_orders, old_part = load(spark, sf_dir, "old_customer", "old_orders", "old_part")
    src = {"customer": customer, "orders": orders, "part": part, "events": events}
    tgt = {"customer": old_customer, "orders": old_orders, "part": old_part, "supplier": supplier}
    keys = {"customer": ["c_custkey"], "part": ["p_partkey"], "events": ["event_id"]}
    summaries = D.diff_summary_all(src, tgt, keys) if with_summaries else None
    return I.table_inventory(src, tgt, keys, summaries)


_ONE_SIDED = """SELECT 'events' AS table_name, 'Added' AS status, count(*) AS source_rows, CAST(NULL AS BIGINT) AS target_rows FROM events
UNION ALL SELECT 'supplier', 'Removed', NULL, count(*) FROM supplier
UNION ALL SELECT 'orders', 'No key', NULL, NULL"""


@registry.add("table_inventory", f"{_ONE_SIDED} UNION ALL SELECT 'customer', 'Comparable', NULL, NULL UNION ALL SELECT 'part', 'Comparable', NULL, NULL")
def table_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir)


@registry.add(
    "filter_inventory",
    f"""{_DIFFS}
SELECT 'Different' AS filter, 'customer' AS table_name, count(*) FILTER (op <> 'D') AS source_rows, count(*) FILTER (op <> 'I') AS target_rows FROM dc
UNION ALL SELECT 'Synchronized', 'part', count(*), count(*) FROM part
UNION ALL SELECT 'Added', 'events', count(*), NULL FROM events
UNION ALL SELECT 'Removed', 'supplier', NULL, count(*) FROM supplier
UNION ALL SELECT 'No key', 'orders', NULL, NULL""",
)
def filter_inventory(spark, sf_dir):
    inventory = _inventory(spark, sf_dir, with_summaries=True)
    parts = [
        I.filter_inventory(inventory, s).select(F.lit(s).alias("filter"), "table_name", "source_rows", "target_rows")
        for s in ("Different", "Synchronized", "Added", "Removed", "No key", "Comparable")
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


_COUNTED = ("customer", "documents", "events", "lineitem", "orders", "part")


@registry.add("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _COUNTED))
def row_counts(spark, sf_dir):
    return I.row_counts(dict(zip(_COUNTED, load(spark, sf_dir, *_COUNTED))))


_MARKS = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "events": "event_id"}


@registry.add(
    "key_high_water_marks",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{k}' AS key_column, CAST(coalesce(max({k}), 1) AS BIGINT) AS high_water_mark FROM {t}"
        for t, k in _MARKS.items()
    ),
)
def key_high_water_marks(spark, sf_dir):
    frames = load(spark, sf_dir, *_MARKS)
    return I.key_high_water_marks({t: (df, _MARKS[t]) for t, df in zip(_MARKS, frames)})


@registry.add("find_row", "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE CAST(doc_id AS VARCHAR) = '7'")
def find_row(spark, sf_dir):
    (documents,) = load(spark, sf_dir, "documents")
    return I.find_row(documents, "doc_id", "7")


def _share_sql(table: str, frame: str) -> str:
    n = lambda op: f"count(*) FILTER (op = '{op}')"
    row = lambda check, op: (
        f"SELECT '{table}' AS table_name, '{check}' AS check, '' AS detail, {n(op)} AS n_rows, 0.2::DOUBLE AS limit, "
        f"{n(op)} > 0.2 * count(*) FILTER (op <> 'I') AS flagged FROM {frame}"
    )
    return f"{row('bulk_delete', 'D')} UNION ALL {row('bulk_update', 'U')}"


def _null_sql(table: str, frame: str, columns, key: str) -> str:
    sensitive = [c for c in columns if c != key and "key" in c]
    parts = []
    for c in columns:
        if c == key:
            continue
        changed = f"list_contains(string_split(changed, ','), '{c}')"
        if c in sensitive:
            cond = f"(op = 'I' OR (op = 'U' AND {changed})) AND CAST(s_{c} AS VARCHAR) <> ''"
            parts.append(f"SELECT '{table}', 'sensitive_value', '{c}', count(*) FILTER ({cond}), 0.0, count(*) FILTER ({cond}) > 0 FROM {frame}")
        cond = f"op = 'U' AND {changed} AND s_{c} IS NULL AND t_{c} IS NOT NULL"
        parts.append(f"SELECT '{table}', 'unusual_null', '{c}', count(*) FILTER ({cond}), 0.0, count(*) FILTER ({cond}) > 0 FROM {frame}")
    return " UNION ALL ".join(parts)


@registry.add(
    "change_risk",
    f"""{with_frames("old_customer", "old_orders")},
{diff_cte("dc", "old_customer", "customer", ["c_custkey"], CUSTOMER)},
{diff_cte("dor", "old_orders", "orders", ["o_orderkey"], ORDERS)}
{_share_sql('customer', 'dc')} UNION ALL {_share_sql('orders', 'dor')}
UNION ALL {_null_sql('customer', 'dc', CUSTOMER, 'c_custkey')} UNION ALL {_null_sql('orders', 'dor', ORDERS, 'o_orderkey')}
UNION ALL SELECT 'orders', 'orphan', 'o_custkey -> customer', count(*), 0.0, count(*) > 0
  FROM old_orders WHERE o_custkey NOT IN (SELECT c_custkey FROM old_customer)""",
)
def change_risk(spark, sf_dir):
    """Risk of going back from the tables to their earlier snapshots."""
    src, tgt = _sides(spark, sf_dir)
    pick = lambda tables: {t: tables[t] for t in ("customer", "orders")}
    return R.change_risk(pick(tgt), pick(src), KEYS, [EDGE])


@registry.add(
    "release_plan",
    f"""{_DIFFS}
SELECT 'summary' AS part, table_name, status AS op, source_rows AS n_rows FROM ({summary('customer', 'dc')} UNION ALL {summary('orders', 'dor')} UNION ALL {summary('part', 'dp')})
UNION ALL SELECT 'feed', 'customer', op, count(*) FROM dc WHERE op <> 'S' GROUP BY op
UNION ALL SELECT 'feed', 'orders', op, count(*) FROM dor WHERE op <> 'S' GROUP BY op
UNION ALL SELECT 'applied', 'customer', '', count(*) FROM customer UNION ALL SELECT 'applied', 'orders', '', count(*) FROM orders
UNION ALL SELECT 'applied', 'part', '', count(*) FROM part""",
)
def release_plan(spark, sf_dir):
    """Summary, feed and resulting tables from diffs that are run once."""
    src, tgt = _sides(spark, sf_dir)
    release = compare_release(src, tgt, KEYS)
    feed = release.feed([EDGE]).groupBy("table_name", "op").agg(F.count("*").alias("n_rows"))
    rows = lambda t: release.applied(t, tgt[t]).agg(F.lit(t).alias("table_name"), F.lit("").alias("op"), F.count("*").alias("n_rows"))
    applied = union_all([rows(t) for t in sorted(release.diffs)])
    return (
        release.summary().select(F.lit("summary").alias("part"), "table_name", F.col("status").alias("op"), F.col("source_rows").alias("n_rows"))
        .unionAll(feed.select(F.lit("feed"), "table_name", "op", "n_rows"))
        .unionAll(applied.select(F.lit("applied"), "table_name", "op", "n_rows"))
    )
