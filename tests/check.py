"""Run registered queries against their SQL: python -m tests.check [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from queries.frames import TABLES

TESTDATA = "/root/testdata"


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(repr(value))
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(_cell(r[i])).__name__, _cell(r[i])) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, function, sql: str | None) -> str:
    """Empty when both agree, else what differs."""
    df = function(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if sql is None:
        return "" if got else "no rows"
    relation = con.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    want = _rows(relation.columns, relation.fetchall())
    if got == want:
        return "" if want else "both empty"
    extra, missing = got - want, want - got
    return (
        f"{sum(got.values())} rows != {sum(want.values())}; columns {sorted(df.columns)}\n"
        f"  only Spark {sum(extra.values())}: {list(extra)[:3]}\n  only SQL {sum(missing.values())}: {list(missing)[:3]}"
    )


def main() -> int:
    from queries import all_queries
    from tidemark import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    registry = all_queries()
    names = sys.argv[2:] or list(registry.spark)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, registry.spark[name], registry.sql.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in registry.sql else '(rows only)'} {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
