"""Best-of-N wall time of registered queries in one warm session.

usage: python tools/ab.py SF_DIR N query [query ...]"""

import sys
import time

sys.path.insert(0, ".")
from dictgraph import registry  # noqa: E402
from dictgraph.session import local_session  # noqa: E402

sf, n, names = sys.argv[1], int(sys.argv[2]), sys.argv[3:]
import os
spark = local_session(cores=8, shuffle_partitions=int(os.environ.get("AB_SHUFFLE", "16")))
registry.dictionary(spark, sf)["edges"].count()
for name in names:
    best = min(
        (lambda t0: (registry.QUERIES[name](spark, sf).count(), time.perf_counter() - t0)[1])(time.perf_counter())
        for _ in range(n)
    )
    print(f"{name} {best:.2f}")
