from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictgraph.plans.lineage import cut_lineage_observed
from dictgraph.plans.sizing import DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_MAX_BROADCAST_ROWS


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_back(
    requests: DataFrame,
    answers: DataFrame,
    on: str,
    max_broadcast_rows: int | None = None,
    payload=None,
) -> DataFrame:
    """Attach per-distinct-key answers to a (possibly huge, possibly skewed)
    request table. The answers are one row per key; when their row count (and,
    with a ``payload`` column such as a document, their byte size) is within
    bound they are broadcast, so the request side is never shuffled. Both are
    observed while the answers are checkpointed, so nothing is computed twice."""
    limit = DEFAULT_MAX_BROADCAST_ROWS if max_broadcast_rows is None else max_broadcast_rows
    size = F.lit(64)
    if payload is not None:
        size = size + F.coalesce(F.length(F.to_json(as_col(payload))), F.lit(0))
    answers, stats = cut_lineage_observed(answers, bytes=F.coalesce(F.sum(size.cast("long")), F.lit(0)))
    fits = 0 < limit and stats["rows"] <= limit and stats["bytes"] <= DEFAULT_MAX_BROADCAST_BYTES
    right = F.broadcast(answers) if fits else answers
    return requests.join(right, on, "left")
