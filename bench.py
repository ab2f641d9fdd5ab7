"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query wall time (seconds).

Each query is written to Spark's ``noop`` sink, so that every column of every
row is produced and nothing is pruned or collected. Figures are our own; the
original service publishes none.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dictgraph import registry  # noqa: E402
from dictgraph.session import local_session  # noqa: E402

# Every registered query (the driver's correctness set), in registry order.
HEADLINE = list(registry.QUERIES)

# One query per operator family, run once on small data before timing.
WARMUP = [
    "validate_events",
    "membership_counts",
    "resolve_alias",
    "expand_geo_l4",
    "resolve_in_geo",
    "descriptor_fields_parts",
    "fetch_blobs_pages",
    "text_search_documents",
    "domain_filter",
]


def produce(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="dictgraph-bench")
    # Warm-up (JIT, codegen caches) on the smallest data set when present,
    # so the timed runs below measure steady state at the target scale.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in WARMUP:
        produce(registry.QUERIES[name](spark, warm_dir))
    times = {}
    # The derived dictionary (terms + edges), written once per session like a
    # loaded collection; every query below reads it.
    t0 = time.perf_counter()
    d = registry.dictionary(spark, sf_dir)
    produce(d["terms"])
    produce(d["edges"])
    times["derive_dictionary"] = round(time.perf_counter() - t0, 3)
    # Each query runs BENCH_REPEAT times (default 2); the fastest run is
    # reported, which damps noise from other tenants of the host.
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    errors = {}
    for name in names:
        best = None
        try:
            for _ in range(repeat):
                t0 = time.perf_counter()
                produce(registry.QUERIES[name](spark, sf_dir))
                took = time.perf_counter() - t0
                best = took if best is None else min(best, took)
        except Exception as exc:  # keep benchmarking the others; report it
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
            continue
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "repeat": repeat,
                "stat": "min",
                "errors": errors,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
