"""Wall seconds of the headline queries: one JSON line for the driver.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from telltale.plans.registry import catalog  # noqa: E402
from telltale.session import local_session  # noqa: E402

HEADLINE = [
    "attention_queue", "component_status", "fleet_totals", "status_trend", "stale_components", "data_quality",
    "stream_segments", "stream_cadence", "action_statistics", "interval_overlaps", "iou_weighted_f1", "peer_gap",
    "car_features", "ranked_cars", "mode_inventory", "trace_sample", "trace_buckets", "nearest_reading",
    "channel_statistics", "channel_spectrum", "near_duplicate_groups", "stress_statistics", "rainflow_cycles",
    "stress_features", "label_metrics", "class_report", "regression_metrics", "text_sections", "lexical_search",
    "redacted_documents", "unsafe_texts", "nearest_stations", "run_aggregates", "comparison_page", "export_problems",
    "order_events", "forest_status", "live_stream_segments",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    cores = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cpus, shuffle_partitions=cores)
    found = catalog()
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        found[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
