"""Print the formatted physical plan of registered queries.

usage: python tools/explain.py SF_DIR query [query ...]"""

import sys

sys.path.insert(0, ".")
from dictgraph import registry  # noqa: E402
from dictgraph.session import local_session  # noqa: E402

sf, names = sys.argv[1], sys.argv[2:]
spark = local_session(cores=8, shuffle_partitions=8)
for name in names:
    print(f"==================== {name}")
    registry.QUERIES[name](spark, sf).explain("formatted")
