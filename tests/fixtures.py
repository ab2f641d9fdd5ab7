"""Small literal dictionary re-created from what the original test suite
asserts (ISO 639 fragments, core descriptors, one blob)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from dictgraph.functions.constants import BRIDGE_OF, ENUM_OF, SECTION_OF
from dictgraph.sources.dictionary import EDGE_SCHEMA, prepare_terms, terms_from_json

FIELD_OF = "_predicate_field-of"


def edge_rows(spec):
    """``(from, predicate, to, [roots])`` with bare keys -> edge rows."""
    rows = []
    for i, (f, p, t, roots) in enumerate(spec):
        rows.append((f"e{i:03d}", f"terms/{f}" if f is not None else None, f"terms/{t}" if t is not None else None, p,
                     [f"terms/{r}" for r in roots] if roots is not None else None))
    return rows


ISO_EDGES = [
    ("ISO_639_1_en", BRIDGE_OF, "ISO_639_1", ["ISO_639_1"]),
    ("ISO_639_3_eng", ENUM_OF, "ISO_639_1_en", ["ISO_639_1"]),
    ("ISO_639_1_aa", BRIDGE_OF, "ISO_639_1", ["ISO_639_1"]),
    ("ISO_639_3_aar", ENUM_OF, "ISO_639_1_aa", ["ISO_639_1"]),
    ("ISO_639_1_it", BRIDGE_OF, "ISO_639_1", ["ISO_639_1"]),
    ("ISO_639_3_ita", ENUM_OF, "ISO_639_1_it", ["ISO_639_1"]),
    ("ISO_639_scope_I", SECTION_OF, "ISO_639_3", ["ISO_639_3"]),
    ("ISO_639_scope_M", SECTION_OF, "ISO_639_3", ["ISO_639_3"]),
    ("ISO_639_scope_S", SECTION_OF, "ISO_639_3", ["ISO_639_3"]),
    ("ISO_639_type_L", SECTION_OF, "ISO_639_scope_I", ["ISO_639_3"]),
    ("ISO_639_type_C", SECTION_OF, "ISO_639_scope_I", ["ISO_639_3"]),
    ("ISO_639_3_eng", ENUM_OF, "ISO_639_type_L", ["ISO_639_3"]),
    ("ISO_639_3_ita", ENUM_OF, "ISO_639_type_L", ["ISO_639_3"]),
    ("ISO_639_3_aar", ENUM_OF, "ISO_639_type_L", ["ISO_639_3"]),
    ("ISO_639_3_epo", ENUM_OF, "ISO_639_type_C", ["ISO_639_3"]),
    ("_number", ENUM_OF, "_type_scalar", ["_type_scalar"]),
]

CODE_OBJECT = {
    "_closed": {
        "_required": [{"_selection": ["_lid", "_gid", "_aid"]}],
        "_recommended": ["_nid", "_uri", "_pid", "_name", "_symbol", "_symbol_print", "_regexp", "_emoji"],
    }
}


def _doc(gid, info=True, **extra):
    d = {"_code": {"_gid": gid}}
    if info:
        d["_info"] = {"_title": {"ISO_639_3_eng": gid.replace("_", " ")}}
    d.update(extra)
    return d


def iso_terms():
    docs = []
    for g in ["ISO_639_1", "ISO_639_3", "ISO_639_3_eng", "ISO_639_3_ita", "ISO_639_3_aar", "ISO_639_3_epo",
              "ISO_639_scope_I", "ISO_639_scope_M", "ISO_639_scope_S", "ISO_639_type_L", "ISO_639_type_C",
              "_number", "_type_scalar", "_info", "_gid"]:
        docs.append(_doc(g))
    for g in ["ISO_639_1_en", "ISO_639_1_aa", "ISO_639_1_it"]:
        docs.append(_doc(g, info=False))
    docs.append(_doc("_code", _data={"_object": CODE_OBJECT}))
    docs.append(_doc("_lid", _data={"_scalar": {}}))
    return docs


def make_terms(spark, docs):
    rows = [(d["_code"]["_gid"], json.dumps(d)) for d in docs]
    return prepare_terms(terms_from_json(spark.createDataFrame(rows, "_key string, doc string")))


def make_edges(spark, spec):
    return spark.createDataFrame(edge_rows(spec), EDGE_SCHEMA)


def iso_dictionary(spark):
    blobs = spark.createDataFrame(
        [("339d23fc1dbffe043bc69d6db95b5912", "flag", "_text_SVG", "_media_landscape", "ad", "<svg>andorra</svg>")],
        "_key string, _blob_item string, _blob_type string, _blob_kind string, _blob_identifier string, _blob_content string",
    )
    return {"terms": make_terms(spark, iso_terms()), "edges": make_edges(spark, ISO_EDGES), "blobs": blobs}


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def col_values(df, c):
    return sorted(r[c] for r in df.select(c).collect())


def req(spark, data, schema):
    return spark.createDataFrame(data, schema)


__all__ = ["F", "FIELD_OF", "iso_dictionary", "make_terms", "make_edges", "rows", "col_values", "req", "_doc"]
