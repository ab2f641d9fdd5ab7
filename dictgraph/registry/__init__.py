"""Registered queries over the dictionary derived from the driver tables.

Each entry of ``QUERIES`` takes ``(spark, sf_dir)`` and returns a DataFrame of
flat scalar columns; ``ORACLE`` holds the matching DuckDB SQL. Request sets are
derived from the tables themselves, so every query's work grows with the data.
The definitions live in one module per operator family.
"""

from __future__ import annotations

from dictgraph import oracle_sql as osql
from dictgraph.registry.common import dictionary, endpoint_keys, tables
from dictgraph.registry.membership import (
    ORACLE_MEMBERSHIP_COUNTS,
    ORACLE_MEMBERSHIP_OUTBOUND,
    ORACLE_MEMBERSHIP_PAIRS,
    ORACLE_VALIDATE,
    ORACLE_VALIDATE_LINEITEM,
    q_membership_counts,
    q_membership_outbound,
    q_membership_pairs,
    q_validate_events,
    q_validate_lineitem_parts,
)
from dictgraph.registry.terms import (
    ORACLE_LOOKUP_LINEITEM,
    ORACLE_LOOKUP_TERMS,
    ORACLE_RESOLVE_ALIAS,
    q_lookup_lineitem_parts,
    q_lookup_terms,
    q_resolve_alias,
)
from dictgraph.registry.graph import (
    ORACLE_RESOLVE_THEN_CHECK,
    SINGLE_ROOT_EXPANSIONS,
    EXPAND_GEO_REQ,
    EXPAND_NATIONS_REQ,
    EXPAND_ORDERS_REQ,
    EXPAND_REGIONS_REQ,
    GEO_TARGETS_SQL,
    NATION_CODE_TARGETS_SQL,
    oracle_all_roots,
    oracle_expand_geo_full,
    oracle_resolve,
    oracle_resolve_geo_by_section,
    single_root_oracle,
    single_root_query,
    q_expand_all_roots,
    q_expand_branch_nations,
    q_expand_geo_full,
    q_expand_geo_l4,
    q_expand_outbound_orders,
    q_expand_regions,
    q_resolve_geo_by_section,
    q_resolve_in_geo,
    q_resolve_in_supply,
    q_resolve_nation_code,
    q_resolve_then_check_customers,
)
from dictgraph.registry import web
from dictgraph.registry.forms import ORACLE_FORMS, ORACLE_IDENTIFIERS, q_descriptor_forms, q_identifier_fields
from dictgraph.registry.published import (
    ORACLE_BLOBS,
    ORACLE_FACETS,
    ORACLE_FRENCH,
    ORACLE_LIST_BY_TITLE,
    ORACLE_LIST_PAGE,
    q_domain_facets_nested,
    q_published_alias,
    q_published_blobs,
    q_published_domain,
    q_published_expand,
    q_published_list_by_title,
    q_published_list_page,
    q_published_phrase_documents,
    q_published_segment_phrase,
    q_published_text_titles,
    q_published_validate,
    q_text_search_french,
)
from dictgraph.registry.documents import (
    ORACLE_BLOB_KEYS,
    ORACLE_FETCH_BLOBS,
    ORACLE_FIELDS_PARTS,
    ORACLE_FIELDS_STATUS,
    q_blob_keys,
    q_descriptor_fields_parts,
    q_descriptor_fields_status,
    q_fetch_blobs_pages,
)
from dictgraph.registry.search import (
    ORACLE_DOMAIN,
    ORACLE_IDENTIFIER,
    ORACLE_SEGMENT_ALL,
    ORACLE_SEGMENT_ANY,
    ORACLE_SEGMENT_PHRASE,
    ORACLE_TERM_LIST,
    ORACLE_STEMS,
    ORACLE_TEXT_DOCUMENTS,
    ORACLE_TEXT_FOLDED,
    ORACLE_TEXT_STEMMED,
    ORACLE_TEXT_TITLES,
    q_domain_filter,
    q_identifier_search,
    q_segment_search_all,
    q_segment_search_any,
    q_segment_search_phrase,
    q_term_list_view,
    q_stems,
    q_text_search_documents,
    q_text_search_folded,
    q_text_search_stemmed,
    q_text_search_titles,
)

__all__ = ["QUERIES", "ORACLE", "dictionary", "endpoint_keys", "tables"]

QUERIES = {
    "validate_events": lambda s, d: q_validate_events(s, d, "flag"),
    "validate_events_valid": lambda s, d: q_validate_events(s, d, "valid"),
    "validate_events_invalid": lambda s, d: q_validate_events(s, d, "invalid"),
    "validate_lineitem_parts": q_validate_lineitem_parts,
    "membership_counts": q_membership_counts,
    "membership_pairs": q_membership_pairs,
    "membership_outbound": q_membership_outbound,
    "resolve_alias": q_resolve_alias,
    "lookup_terms": q_lookup_terms,
    "lookup_lineitem_parts": q_lookup_lineitem_parts,
    "expand_geo_l4": q_expand_geo_l4,
    "expand_regions": q_expand_regions,
    "expand_branch_nations": q_expand_branch_nations,
    "expand_all_roots": q_expand_all_roots,
    "expand_outbound_orders": q_expand_outbound_orders,
    **{name: single_root_query(root, lv) for name, (root, lv) in SINGLE_ROOT_EXPANSIONS.items()},
    "expand_geo_full": q_expand_geo_full,
    "resolve_in_geo": q_resolve_in_geo,
    "resolve_in_supply": q_resolve_in_supply,
    "resolve_nation_code": q_resolve_nation_code,
    "resolve_geo_by_section": q_resolve_geo_by_section,
    "resolve_then_check_customers": q_resolve_then_check_customers,
    "descriptor_fields_parts": q_descriptor_fields_parts,
    "descriptor_fields_status": q_descriptor_fields_status,
    "descriptor_forms": q_descriptor_forms,
    "blob_keys": q_blob_keys,
    "fetch_blobs_pages": q_fetch_blobs_pages,
    "segment_search_phrase": q_segment_search_phrase,
    "segment_search_all": q_segment_search_all,
    "segment_search_any": q_segment_search_any,
    "identifier_search": q_identifier_search,
    "identifier_fields": q_identifier_fields,
    "text_search_titles": q_text_search_titles,
    "text_search_documents": q_text_search_documents,
    "text_search_folded": q_text_search_folded,
    "text_search_stemmed": q_text_search_stemmed,
    "stems": q_stems,
    "domain_filter": q_domain_filter,
    "term_list_view": q_term_list_view,
    "domain_facets_nested": q_domain_facets_nested,
    "published_expand": q_published_expand,
    "published_validate": q_published_validate,
    "published_alias": q_published_alias,
    "published_segment_phrase": q_published_segment_phrase,
    "published_text_titles": q_published_text_titles,
    "published_domain": q_published_domain,
    "published_phrase_documents": q_published_phrase_documents,
    "published_list_by_title": q_published_list_by_title,
    "published_list_page": q_published_list_page,
    "published_blobs": q_published_blobs,
    "text_search_french": q_text_search_french,
    **web.QUERIES,
}

ORACLE = {
    "validate_events": osql.with_(ORACLE_VALIDATE["flag"]),
    "validate_events_valid": osql.with_(ORACLE_VALIDATE["valid"]),
    "validate_events_invalid": osql.with_(ORACLE_VALIDATE["invalid"]),
    "validate_lineitem_parts": osql.with_(ORACLE_VALIDATE_LINEITEM),
    "membership_counts": ORACLE_MEMBERSHIP_COUNTS,
    "membership_pairs": ORACLE_MEMBERSHIP_PAIRS,
    "membership_outbound": ORACLE_MEMBERSHIP_OUTBOUND,
    "resolve_alias": ORACLE_RESOLVE_ALIAS,
    "lookup_terms": ORACLE_LOOKUP_TERMS,
    "lookup_lineitem_parts": ORACLE_LOOKUP_LINEITEM,
    "expand_geo_l4": osql.expand_sql(EXPAND_GEO_REQ, 4),
    "expand_regions": osql.expand_sql(EXPAND_REGIONS_REQ, 3),
    "expand_branch_nations": osql.expand_sql(EXPAND_NATIONS_REQ, 2),
    "expand_all_roots": oracle_all_roots(),
    "expand_outbound_orders": osql.expand_sql(EXPAND_ORDERS_REQ, 4, "outbound"),
    **{name: single_root_oracle(root, lv) for name, (root, lv) in SINGLE_ROOT_EXPANSIONS.items()},
    "expand_geo_full": oracle_expand_geo_full(),
    "resolve_in_geo": oracle_resolve(f"SELECT request_id, target, 'geo' AS root FROM ({GEO_TARGETS_SQL})"),
    "resolve_in_supply": oracle_resolve(
        f"SELECT request_id, target, 'supply' AS root FROM ({GEO_TARGETS_SQL} UNION ALL SELECT s_suppkey * 4 + 100000000, concat('supp_', CAST(s_suppkey AS STRING)) FROM supplier)"
    ),
    "resolve_nation_code": oracle_resolve(NATION_CODE_TARGETS_SQL),
    "resolve_geo_by_section": oracle_resolve_geo_by_section(),
    "resolve_then_check_customers": ORACLE_RESOLVE_THEN_CHECK,
    "descriptor_fields_parts": ORACLE_FIELDS_PARTS,
    "descriptor_fields_status": ORACLE_FIELDS_STATUS,
    "descriptor_forms": ORACLE_FORMS,
    "blob_keys": ORACLE_BLOB_KEYS,
    "fetch_blobs_pages": ORACLE_FETCH_BLOBS,
    "segment_search_phrase": ORACLE_SEGMENT_PHRASE,
    "segment_search_all": ORACLE_SEGMENT_ALL,
    "segment_search_any": ORACLE_SEGMENT_ANY,
    "identifier_search": ORACLE_IDENTIFIER,
    "identifier_fields": ORACLE_IDENTIFIERS,
    "text_search_titles": ORACLE_TEXT_TITLES,
    "text_search_documents": ORACLE_TEXT_DOCUMENTS,
    "text_search_folded": ORACLE_TEXT_FOLDED,
    "text_search_stemmed": ORACLE_TEXT_STEMMED,
    "stems": ORACLE_STEMS,
    "domain_filter": ORACLE_DOMAIN,
    "term_list_view": ORACLE_TERM_LIST,
    "domain_facets_nested": ORACLE_FACETS,
    "published_expand": osql.expand_sql(EXPAND_REGIONS_REQ, 3),
    "published_validate": osql.with_(ORACLE_VALIDATE["flag"]),
    "published_alias": ORACLE_RESOLVE_ALIAS,
    "published_segment_phrase": ORACLE_SEGMENT_PHRASE,
    "published_text_titles": ORACLE_TEXT_TITLES,
    "published_domain": ORACLE_DOMAIN,
    "published_phrase_documents": ORACLE_TEXT_DOCUMENTS,
    "published_list_by_title": ORACLE_LIST_BY_TITLE,
    "published_list_page": ORACLE_LIST_PAGE,
    "published_blobs": ORACLE_BLOBS,
    "text_search_french": ORACLE_FRENCH,
    **web.ORACLE,
}
