"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from ebbmark.session import session  # noqa: E402

HEADLINE = [
    "ground_truth_windows",
    "running_max_by_arrival",
    "house_naive_windows",
    "house_fixed_slack_windows",
    "house_mean_shift_windows",
    "house_adwin_settled_windows",
    "adwin_split_windows",
    "taxi_fixed_slack_windows",
    "taxi_mean_shift_windows",
    "taxi_speculative_updates",
    "flags_house_mean_shift",
    "house_sensitivity_all_variants",
    "taxi_sensitivity_all_variants",
    "house_comparison",
    "taxi_comparison",
    "house_series_completeness_1m",
    "zone_errors",
    "taxi_monitor",
    "stream_house_fixed_slack",
    "stream_house_mean_shift",
]


def consume(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from registry import QUERIES
    consume(spark.read.parquet(f"{folder}/events.parquet"))  # JVM warm-up
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        start = time.perf_counter()
        consume(QUERIES[name].run(spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
