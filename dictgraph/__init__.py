"""dictgraph — metadata-dictionary operators on Spark DataFrames.

A dictionary is a DataFrame of term documents (``_key``, ``doc`` VARIANT)
plus a DataFrame of typed edges (``_key``, ``_from``, ``_to``,
``_predicate``, ``_path``) that place terms into enumeration hierarchies.
Every operator takes a DataFrame of requests and answers all of them in one
distributed job.
"""

from dictgraph.operators.terms import resolve_alias, lookup_terms
from dictgraph.operators.membership import (
    check_membership,
    membership_pairs,
    validate_column,
    resolve_then_check,
)
from dictgraph.operators.expand import expand_enum
from dictgraph.operators.resolve import resolve_in_graph
from dictgraph.operators.fields import descriptor_fields
from dictgraph.operators.blobs import fetch_blobs
from dictgraph.functions.keys import blob_key
from dictgraph.operators.search import (
    segment_index,
    segment_search,
    identifier_index,
    identifier_search,
    text_index,
    text_index_frame,
    text_search,
    domain_index,
    domain_filter,
    term_list_view,
)
from dictgraph.plans.publish import materialize, drop_materialized, publish_dictionary, drop_dictionary
from dictgraph.sources.dictionary import read_terms, read_edges, read_blobs, terms_from_json, prepare_terms
from dictgraph.sources.sinks import write_json, write_parquet

__all__ = [
    "resolve_alias",
    "lookup_terms",
    "check_membership",
    "membership_pairs",
    "validate_column",
    "resolve_then_check",
    "expand_enum",
    "resolve_in_graph",
    "descriptor_fields",
    "fetch_blobs",
    "blob_key",
    "segment_index",
    "segment_search",
    "identifier_index",
    "identifier_search",
    "text_index",
    "text_index_frame",
    "text_search",
    "domain_index",
    "domain_filter",
    "term_list_view",
    "materialize",
    "drop_materialized",
    "publish_dictionary",
    "drop_dictionary",
    "read_terms",
    "read_edges",
    "read_blobs",
    "terms_from_json",
    "prepare_terms",
    "write_json",
    "write_parquet",
]
