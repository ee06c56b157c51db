"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs
to the end over its whole tables, its rows going to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import sys
import time

from queries import all_queries
from tidemark import get_session

HEADLINE = (
    "row_diff", "diff_summary", "diff_summary_composite_key", "row_diff_duplicate_keys", "diff_summary_all",
    "change_feed", "apply_update", "render_dml", "scan_records_substring", "scan_records_token", "dedupe_hits",
    "junk_report", "cascade_impact", "cascade_rows", "purge", "topological_levels", "transitive_dependents",
    "column_diff", "object_diff", "schema_change_plan", "line_diff", "json_diff", "drift_report",
    "signature_scan", "drop_marked_regions", "rule_audit", "normalize_log",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = all_queries()
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.spark[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
