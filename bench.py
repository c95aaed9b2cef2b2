"""Times the headline queries at $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import sys
import time

from presage.catalog import QUERIES
from presage.session import build_session

HEADLINE = (
    "table_profile", "trace_overview", "usage_by_hour", "usage_quantiles", "usage_histogram",
    "task_window_features", "machine_window_features", "forward_label_next", "lag_sequence",
    "exhaustion_pattern", "load_before_removal", "request_vs_peak", "usage_sample", "stratified_folds",
    "time_split_stats", "zscore_report", "ranking_metrics", "ranking_metrics_by_group", "threshold_sweep",
    "drift_by_bin", "lead_time_summary", "machine_risk_series", "replay", "logreg_scores", "gbt_scores",
    "stream_window_features", "ingest_manifest", "ingest_increment", "merged_windows", "quantiles_by_span",
    "stream_first_alerts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
