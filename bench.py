"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times into a discarding sink;
the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "filter_bool", "filter_truthy", "transform_reshape", "truncate_cells", "json_path",
    "join_inner", "join_left", "join_outer", "join_null_safe", "join_prefix",
    "group_multi_key", "agg_sum", "agg_min_max", "group_ordered", "concat",
    "src_csv", "src_ndjson", "src_sql_cte", "src_sql_window", "src_sql_distinct_agg", "src_api_items", "src_next_page",
    "src_key_lookup", "src_type_infer", "json_quarantine",
    "describe", "low_cardinality", "dict_encode", "profile_distinct", "histogram",
    "latest_state", "recent_n", "trailing_usage", "quota_admission", "kpi_delta", "duration_buckets", "audit_page",
    "text_search", "classify_error", "limit_ordered",
    "flow_linear", "flow_join_agg", "flow_fanout", "export_csv", "export_parquet",
    "chart_data", "chart_share", "downsample_minmax", "st_windowed_counts", "st_latest_state",
)


def main() -> None:
    from tidewell.catalogue import QUERIES
    from tidewell.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in sys.argv[1:] if n in QUERIES] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken[1:]), 3)
    sf = float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
