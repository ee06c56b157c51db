"""Sources, sinks and streams: written below the checkpoint folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queries import Registry
from queries.frames import load, with_frames
from queries.lines import _CLEAN, _SEVERITY
from queries.sqltext import CUSTOMER, ORDERS, diff_cte
from queries.tables import _feed
from tidemark.operators import sync as S
from tidemark.operators.digests import differing_ranges
from tidemark.operators.keys import union_all
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import files as X, snapshots as P
from tidemark.streaming import logs as T

registry = Registry()


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


_FEED_COUNTS = f"""{with_frames("old_customer", "old_orders")},
{diff_cte("dc", "customer", "old_customer", ["c_custkey"], CUSTOMER)},
{diff_cte("dor", "orders", "old_orders", ["o_orderkey"], ORDERS)}
SELECT 'customer' AS table_name, op, count(*) AS n_rows FROM dc WHERE op <> 'S' GROUP BY op
UNION ALL SELECT 'orders', op, count(*) FROM dor WHERE op <> 'S' GROUP BY op"""


@registry.add("write_change_set", _FEED_COUNTS)
def write_change_set(spark, sf_dir):
    path = _folder(spark)
    P.write_change_set(_feed(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("table_name", "op").agg(F.count("*").alias("n_rows"))


@registry.add("write_script", _FEED_COUNTS)
def write_script(spark, sf_dir):
    path = _folder(spark)
    P.write_script(_feed(spark, sf_dir), path, S.FEED_ORDER)
    text = spark.read.text(path)
    verb = F.regexp_extract("value", "^(DELETE|INSERT|UPDATE)", 1)
    table = F.regexp_extract("value", 'public\\."(\\w+)"', 1)
    return text.groupBy(table.alias("table_name"), F.substring(verb, 1, 1).alias("op")).agg(F.count("*").alias("n_rows"))


_EXPORTED = ("customer", "lineitem", "orders", "part")


@registry.add("export_snapshot", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _EXPORTED))
def export_snapshot(spark, sf_dir):
    return P.export_snapshot(dict(zip(_EXPORTED, load(spark, sf_dir, *_EXPORTED))), _folder(spark))


@registry.add("read_export", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, 0 AS ranges_that_differ FROM {t}" for t in _EXPORTED))
def read_export(spark, sf_dir):
    """An export read back by its manifest and held against the tables."""
    path, tables = _folder(spark), dict(zip(_EXPORTED, load(spark, sf_dir, *_EXPORTED)))
    P.export_snapshot(tables, path)
    back = P.read_export(spark, path)

    def held(table):
        source, copy = tables[table], back[table]
        differ = differing_ranges(source, copy, source.columns, ()).agg(F.lit(0).cast("bigint").alias("n_rows"), F.count("*").alias("n"))
        rows = copy.agg(F.count("*").alias("n_rows"), F.lit(0).cast("bigint").alias("n"))
        both = differ.unionByName(rows).agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("ranges_that_differ"))
        return both.select(F.lit(table).alias("table_name"), "*")

    return union_all([held(t) for t in _EXPORTED])


@registry.add("read_snapshot", "SELECT o_orderstatus, count(*) AS n_rows FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus")
def read_snapshot(spark, sf_dir):
    orders = P.read_snapshot(spark, sf_dir, ["orders"], "o_orderstatus <> 'P'", suffix=".parquet")["orders"]
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"))


@registry.add("read_config_tree", "SELECT c_mktsegment AS folder, count(*) AS n_rows FROM customer GROUP BY c_mktsegment")
def read_config_tree(spark, sf_dir):
    """Customers written as .json files, one folder per segment."""
    path = _folder(spark)
    (customer,) = load(spark, sf_dir, "customer")
    customer.withColumn("folder", F.col("c_mktsegment")).write.partitionBy("folder").json(path)
    files = X.read_config_tree(spark, path)
    lines = files.select(F.regexp_extract("path", "^folder=(\\w+)/", 1).alias("folder"), F.explode(F.split("content", "\n")).alias("line"))
    return lines.where("line <> ''").groupBy("folder").agg(F.count("*").alias("n_rows"))


@registry.add("read_lines", "SELECT count(*) AS n_lines, true AS all_numbered FROM orders")
def read_lines(spark, sf_dir):
    """Orders written as text; every file's lines must be numbered 1 to n."""
    path = _folder(spark)
    (orders,) = load(spark, sf_dir, "orders")
    orders.select(F.concat_ws("|", "o_orderkey", "o_orderpriority")).write.text(path)
    files = X.read_lines(spark, path).groupBy("file").agg(
        F.count("*").alias("n"), F.min("line_no").alias("low"), F.max("line_no").alias("high"), F.countDistinct("line_no").alias("numbers")
    )
    return files.agg(F.sum("n").alias("n_lines"), F.bool_and(F.expr("low = 1 AND high = n AND numbers = n")).alias("all_numbered"))


@registry.add("normalize_log_stream", f"{_CLEAN}\nSELECT line FROM n")
def normalize_log_stream(spark, sf_dir):
    folder, out, state = _folder(spark), _folder(spark), _folder(spark)
    (log,) = load(spark, sf_dir, "log_lines")
    log.select("line").write.text(folder)
    T.write_available(T.log_stream(spark, folder), out, state)
    return spark.read.schema("line string").parquet(out)


@registry.add("severity_counts_stream", f"{_CLEAN}\nSELECT {_SEVERITY} AS severity, count(*) AS n_lines FROM n GROUP BY 1")
def severity_counts_stream(spark, sf_dir):
    folder, out, state = _folder(spark), _folder(spark), _folder(spark)
    (log,) = load(spark, sf_dir, "log_lines")
    log.select("line").write.text(folder)
    T.count_available(T.severity_stream(T.log_stream(spark, folder, max_files=2)), out, state)
    return T.latest_counts(spark, out)

