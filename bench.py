"""Headline queries timed on the supplied tables; prints one JSON line.

Each query is run to completion into Spark's no-op sink, so nothing is collected. One untimed
query warms the session up.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tempora.plans import all_queries
from tempora.session import build_session

HEADLINE = [
    "asof_backward", "nearest_within_tolerance", "window_count_join", "prev_next_event", "peri_event_slice", "segment_movements",
    "segmentation_sweep", "movement_metrics", "movement_timing", "trial_features", "unit_trial_counts", "unit_class_rates", "peth",
    "auc_by_bin", "tuning_curve", "detector_grid", "unit_correlations", "ols_per_unit", "mann_whitney", "registry_screen",
    "spatial_trend_perm", "bootstrap_std_ci", "event_wide", "percentile_band", "describe_values",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.log.level": "ERROR",
    })
    queries, _ = all_queries()

    def run(name):
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    run("unit_correlations")
    times = {name: run(name) for name in HEADLINE}
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
