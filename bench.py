"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import workload  # noqa: E402

HEADLINE = [
    "scan_time_range", "regular_series", "interpolate_rows", "upsample_hourly", "unify_by_column", "unify_by_row",
    "rolling_features", "all_features", "model_features", "irregular_features", "physics_formulas", "weather_classes",
    "climate_normals", "code_lookup", "radius_search", "nearest_stations", "station_merge", "nearest_grid_points",
    "grid_to_locations", "scaler_statistics", "supervised_windows", "sample_per_location", "split_exact", "scores_by_variable",
    "formatted_forecast", "rain_for_locations",
    # Whole jobs, long windows and kept series.
    "training_dataset", "forecaster_scores", "prediction_input", "latest_features", "dataset_statistics", "collected_series",
    "long_windows", "kept_series",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("isobar-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if "BENCH_CHECKPOINT_DIR" in os.environ:
        builder = builder.config("spark.checkpoint.dir", os.environ["BENCH_CHECKPOINT_DIR"])
    else:
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="isobar-bench-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
