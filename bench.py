"""Benchmark the headline queries.

Runs each query once to warm up, then ``BENCH_REPEAT`` (default 3) timed
runs; a run executes the whole plan into Spark's ``noop`` sink (no driver
collection).  Prints one JSON line with the median seconds per query and
their sum.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_REPEAT (default 3), BENCH_QUERIES (comma list, optional)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from obslytics.plans import catalog  # noqa: E402
from obslytics.session import checkpoint_dir, get_spark  # noqa: E402

HEADLINE = [
    "activities_enriched", "summary", "patterns", "insights", "analysis_report", "chart_summary",
    "daily_category", "weekday_by_hour", "activity_correlation", "box_by_weekday", "confidence_density",
    "gap_minutes", "gaps_by_activity", "gap_histogram", "metric_alerts", "metrics_summary", "latest_metrics",
    "timeline", "recent", "sequences", "temporal_features", "statistical_features", "classification_report",
    "stratified_split", "box_activity", "upload_detections", "fluent_by_date", "stream_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    scratch = tempfile.mkdtemp(prefix="obslytics-bench-")
    spark = get_spark(f"local[{cpus}]", cpus, extra={
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.warehouse.dir": f"{scratch}/warehouse",
        "spark.local.dir": f"{scratch}/local",
    })
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    times: dict[str, float] = {}
    for name in names:
        fn = catalog.QUERIES[name]
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 4)
    sf_name = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf: float | str = float(sf_name)
    except ValueError:
        sf = sf_name
    print(json.dumps({"metric": "headline_query_time_sum", "value": round(sum(times.values()), 4), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
