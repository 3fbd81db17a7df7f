"""Bench: wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Each query is run to completion with the `noop` sink
(every row computed, nothing collected); every headline query runs once on
the smallest folder first, so JVM start-up and code generation are not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sequin.plans.queries import QUERIES  # noqa: E402
from sequin.session import local_session  # noqa: E402

# The two verdicts and the pipeline stages they are built from.
HEADLINE = [
    "verdict_presence",
    "verdict_ordered",
    "enumerate_sequences",
    "shapelet_series_map",
    "presence_matrix",
    "ordered_match",
    "tas_combine",
]


def _run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # one shuffle partition per core (AQE coalesces further)
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="sequin-bench")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for name in HEADLINE:
            _run(spark, name, warm)
    times = {name: round(_run(spark, name, sf_dir), 3) for name in HEADLINE}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
