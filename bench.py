"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from twinedge.plans.queries import QUERIES
from twinedge.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "threshold_sweep",
    "connected_components",
    "metapath_colleague",
    "author_views",
    "neighbour_mean",
    "edge_scores",
    "resolve_all_relations",
    "graph_summary",
    "blocking_report",
    "edge_splits",
    "roc_auc",
    "confusion_metrics",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session(CPUS)
    # starts the JVM's code paths and the Python workers
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("roc_auc", "connected_components"):
            run(spark, name, small)
    seconds = {name: run(spark, name, SF_DIR) for name in HEADLINE}
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
