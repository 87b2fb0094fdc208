"""Wall-clock seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR   folder with the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated query names, or "all" (default: the headline list)
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks import REGISTRY
from flowlab.session import build_session

HEADLINE = [
    "alert_distribution",
    "flat_predictions",
    "conform_project",
    "class_weights",
    "label_to_family",
    "balanced_sample",
    "family_capped_sample",
    "train_val_split",
    "label_permutation",
    "overlap_report",
    "exclude_overlap",
    "exclude_text_overlap",
    "hard_cases",
    "threshold_decision_serve",
    "threshold_decision_tune",
    "hierarchical_decision",
    "classification_report",
    "event_average_precision",
    "tune_thresholds",
    "tuning_experiment",
    "model_summary",
    "csv_union_by_name",
    "stream_score",
    "train_logreg",
    "train_forest",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["class_support"][0](spark, sf).collect()  # start-up cost is not a query
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline queries, total wall-clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
