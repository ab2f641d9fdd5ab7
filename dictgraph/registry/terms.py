"""Registered queries of alias resolution and bulk lookup (O1, O2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dictgraph import oracle_sql as osql
from dictgraph.operators.terms import lookup_terms, resolve_alias

from dictgraph.registry.common import dictionary, endpoint_keys, tables

# ------------------------------------------------------------------ O1 / O2


def q_resolve_alias(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    req = endpoint_keys(d["edges"], d["terms"])
    return resolve_alias(req, d["terms"], d["edges"], with_doc=False).select("gid", "resolved_gid", "status")


ORACLE_RESOLVE_ALIAS = osql.with_(
    """
SELECT e.gid, r.resolved_gid, CASE WHEN r.resolved_gid IS NULL THEN 'not_found' ELSE 'ok' END AS status
FROM endpoint_keys e LEFT JOIN resolved r ON r.gid = e.gid""",
    extra=osql.resolve_keys_cte("SELECT gid FROM endpoint_keys"),
)


def q_lookup_terms(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (customer,) = tables(spark, sf_dir, "customer")
    req = customer.select(
        (F.col("c_custkey") * 2).alias("pos"), F.concat(F.lit("nation_code_"), F.col("c_nationkey").cast("string")).alias("gid")
    ).unionByName(
        customer.select((F.col("c_custkey") * 2 + 1).alias("pos"), F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("gid"))
    )
    out = lookup_terms(req, d["terms"], d["edges"], with_doc=True)
    return out.select(
        F.col("pos").cast("long").alias("pos"),
        "gid",
        "resolved_gid",
        F.try_variant_get("doc", "$._info._title.ISO_639_3_eng", "string").alias("title"),
    )


_LOOKUP_REQ = """SELECT c_custkey * 2 AS pos, concat('nation_code_', CAST(c_nationkey AS STRING)) AS gid FROM customer
UNION ALL SELECT c_custkey * 2 + 1, concat('cust_', CAST(c_custkey AS STRING)) FROM customer"""

ORACLE_LOOKUP_TERMS = osql.with_(
    f"""
SELECT CAST(q.pos AS BIGINT) AS pos, q.gid, r.resolved_gid, json_extract_string(t.doc, '$._info._title.ISO_639_3_eng') AS title
FROM ({_LOOKUP_REQ}) q JOIN resolved r ON r.gid = q.gid JOIN terms t ON t._key = r.resolved_gid""",
    extra=osql.resolve_keys_cte(_LOOKUP_REQ),
)

def q_lookup_lineitem_parts(spark, sf_dir):
    """Every line item's part document (one lookup per distinct part)."""
    d = dictionary(spark, sf_dir)
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    req = lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
        F.concat(F.lit("part_item_"), F.col("l_partkey").cast("string")).alias("gid"),
    )
    out = lookup_terms(req, d["terms"], d["edges"], with_doc=True)
    return out.select(
        F.col("pos").cast("long").alias("pos"), "gid", "resolved_gid",
        F.try_variant_get("doc", "$._info._title.ISO_639_3_eng", "string").alias("title"),
    )


_LOOKUP_LINEITEM_REQ = "SELECT l_orderkey * 8 + l_linenumber AS pos, concat('part_item_', CAST(l_partkey AS STRING)) AS gid FROM lineitem"

ORACLE_LOOKUP_LINEITEM = osql.with_(
    f"""
SELECT CAST(q.pos AS BIGINT) AS pos, q.gid, r.resolved_gid, json_extract_string(t.doc, '$._info._title.ISO_639_3_eng') AS title
FROM ({_LOOKUP_LINEITEM_REQ}) q JOIN resolved r ON r.gid = q.gid JOIN terms t ON t._key = r.resolved_gid""",
    extra=osql.resolve_keys_cte(_LOOKUP_LINEITEM_REQ),
)
