"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logvane.session import local_session  # noqa: E402
from workload import registry  # noqa: E402
from workload.raw_events import normalized  # noqa: E402

HEADLINE = [
    "normalize_events", "label_breakdown", "rule_techniques", "zscore_features", "zmax_flags", "scored_events",
    "detector_report", "event_detectors", "lineitem_detectors", "clean_documents", "term_weights", "topic_keywords",
    "density_clusters", "event_topics", "nearest_passages", "retrieval_contexts", "enriched_events", "grounding_proxy",
    "condition_comparison", "severity_heatmap", "stream_labels", "stream_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    if chosen == ["all"]:
        chosen = list(registry.QUERIES)
    spark = local_session("bench", cores=cpus, shuffle_partitions=cpus)
    seconds = {}
    # the stage table that later stages read is timed on its own, as stage_normalize
    start = time.perf_counter()
    normalized(spark, sf_dir).count()
    seconds["stage_normalize"] = round(time.perf_counter() - start, 3)
    for name in chosen:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
