"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lagwise import catalog

HEADLINE = ["lagged_rolling_mean", "ewma_span10", "ewma_halflife20", "rest_days", "run_length", "season_zscore", "feature_fanout", "schedule_strength",
            "pair_games", "home_win_by_form", "rating_replay", "efficiency_ratios", "roster_rollup", "game_table_full", "roc_auc", "calibration_bins",
            "blend_weights", "scale_fit_train", "lr_fit"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    seconds = {}
    found[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warms the JVM
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
