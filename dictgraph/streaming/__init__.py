from dictgraph.streaming.validate import (
    current_table,
    fetch_blobs_each_batch,
    fetch_blobs_stream,
    for_each_batch,
    resolve_alias_each_batch,
    resolve_alias_stream,
    validate_each_batch,
    validate_stream,
)

__all__ = [
    "current_table",
    "fetch_blobs_each_batch",
    "fetch_blobs_stream",
    "for_each_batch",
    "resolve_alias_each_batch",
    "resolve_alias_stream",
    "validate_each_batch",
    "validate_stream",
]
