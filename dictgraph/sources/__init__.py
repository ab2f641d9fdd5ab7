from dictgraph.sources.dictionary import (
    EDGE_SCHEMA,
    BLOB_SCHEMA,
    read_terms,
    read_edges,
    read_blobs,
    terms_from_json,
    prepare_terms,
)
from dictgraph.sources.derived import derive_dictionary, read_tables
from dictgraph.sources.sinks import variants_as_json, write_json, write_parquet

__all__ = [
    "EDGE_SCHEMA",
    "BLOB_SCHEMA",
    "read_terms",
    "read_edges",
    "read_blobs",
    "terms_from_json",
    "prepare_terms",
    "derive_dictionary",
    "read_tables",
    "variants_as_json",
    "write_json",
    "write_parquet",
]
