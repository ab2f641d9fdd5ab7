"""O8 ``fetch_blobs``: content-addressed blob lookup.

A request key may be bare or a ``blobs/<key>`` handle. Found keys return the
whole document, others ``not_found``. The distinct request keys (nothing else
of the requests) are broadcast when their rows and bytes are within bound, so
the blob table streams past them in one scan and only found documents move; a
small set is also pushed into that scan, where a table in key order with Bloom
filters on the key (O15) passes over row groups without them;
beyond the bound, keys are matched first and content is attached last. Misses
are the requests without a found document: no second scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.functions.constants import BLOBS, NOT_FOUND, OK
from dictgraph.functions.keys import strip_collection
from dictgraph.operators.search import MAX_PUSHED_TOKENS, restrict_to_tokens
from dictgraph.plans.lineage import cut_lineage_observed
from dictgraph.plans.sizing import DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_MAX_BROADCAST_ROWS

BLOB_COLUMNS = ["_blob_item", "_blob_type", "_blob_kind", "_blob_identifier", "_blob_content"]


def fetch_blobs(requests: DataFrame, blobs: DataFrame, key_col: str = "key", max_broadcast_rows: int | None = None) -> DataFrame:
    """Requests plus ``_key``, the blob columns and ``status``."""
    req = requests.withColumn("_key", strip_collection(F.col(key_col), BLOBS))
    limit = DEFAULT_MAX_BROADCAST_ROWS if max_broadcast_rows is None else max_broadcast_rows
    keys, stats = cut_lineage_observed(
        req.select("_key").filter(F.col("_key").isNotNull()).distinct(),
        bytes=F.coalesce(F.sum(F.octet_length("_key") + 64), F.lit(0)),
    )
    payload = blobs.select("_key", *BLOB_COLUMNS)
    if stats["rows"] <= limit and stats["bytes"] <= DEFAULT_MAX_BROADCAST_BYTES:
        if stats["rows"] <= MAX_PUSHED_TOKENS:
            payload = restrict_to_tokens(payload, keys, "_key")
        found = payload.join(F.broadcast(keys), "_key", "left_semi")
    else:
        matched = blobs.select("_key").join(keys, "_key", "left_semi")
        found = payload.join(matched, "_key", "left_semi")
    out = req.join(found.withColumn("status", F.lit(OK)), "_key", "left")
    return out.withColumn("status", F.coalesce("status", F.lit(NOT_FOUND)))
