"""Headline-query benchmark.

Runs the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line:

    {"metric": "total_warm_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is fully materialised with the ``noop`` sink (every row computed,
nothing collected to the driver); one warm-up pass precedes the timed pass.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "cleanse_text",
    "feature_dataset",
    "latest_prediction",
    "reservation_view",
    "queue_store",
    "queue_artifact",
    "dashboard_kpis",
    "operations_summary",
    "no_show_trends",
    "channel_breakdown",
    "action_effectiveness",
    "action_asof_prediction",
    "action_latest_state",
    "classification_metrics",
    "threshold_sweep",
    "topk_capture",
    "calibration_table",
    "layer_prediction_union",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from riskloom.plans.catalog import REGISTRY
    from riskloom.session import get_session

    spark = get_session(
        f"local[{cpus}]",
        shuffle_partitions=int(cpus) * 2,
        extra_conf={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    names = [n for n in HEADLINE if n in REGISTRY]
    only = os.environ.get("BENCH_QUERIES")
    if only:
        names = [n for n in only.split(",") if n in REGISTRY]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for n in names:  # warm-up: JIT, file listing, metadata caches
        run(n)
    timings = {n: round(run(n), 3) for n in names}
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_warm_sec",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
