"""Registered queries of descriptor fields and blobs (O7, O8, O9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dictgraph import oracle_sql as osql
from dictgraph.functions.keys import blob_key
from dictgraph.operators.blobs import fetch_blobs
from dictgraph.operators.fields import descriptor_fields

from dictgraph.registry.common import _long, dictionary, endpoint_keys, tables

# ------------------------------------------------------------------ O7


def q_descriptor_fields_parts(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (part,) = tables(spark, sf_dir, "part")
    req = part.select(F.concat(F.lit("part_item_"), F.col("p_partkey").cast("string")).alias("gid"))
    out = descriptor_fields(req, d["terms"], d["edges"])
    return out.select("gid", "status", *_long("ord"), "field_gid", "required")


_FIELDS_PARTS_REQ = "SELECT concat('part_item_', CAST(p_partkey AS STRING)) AS gid FROM part"

ORACLE_FIELDS_PARTS = osql.with_(
    """
SELECT s.gid, s.status, CAST(o.ord AS BIGINT) AS ord, o.field_gid, o.required
FROM fstatus s LEFT JOIN ordered o ON o.gid = s.gid AND s.status = 'ok'""",
    recursive=True,
    extra=osql.resolve_keys_cte(_FIELDS_PARTS_REQ) + ",\n" + osql.FIELDS_CTE,
)


def q_descriptor_fields_status(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    req = endpoint_keys(d["edges"], d["terms"])
    out = descriptor_fields(req, d["terms"], d["edges"])
    return out.groupBy("gid", "status").agg(F.count("field_gid").cast("long").alias("n_fields"))


ORACLE_FIELDS_STATUS = osql.with_(
    """
SELECT s.gid, s.status, CAST(count(o.field_gid) AS BIGINT) AS n_fields
FROM fstatus s LEFT JOIN ordered o ON o.gid = s.gid AND s.status = 'ok'
GROUP BY s.gid, s.status""",
    recursive=True,
    extra=osql.resolve_keys_cte("SELECT gid FROM endpoint_keys") + ",\n" + osql.FIELDS_CTE,
)

# ------------------------------------------------------------------ O8 / O9


def q_blob_keys(spark, sf_dir):
    (pages,) = tables(spark, sf_dir, "pages")
    return pages.select(*_long("page_id"), blob_key(F.lit("page"), F.lit("_text_HTML"), F.lit("_media_web"), F.col("page_id").cast("string")).alias("blob_key"))


ORACLE_BLOB_KEYS = "SELECT CAST(page_id AS BIGINT) AS page_id, md5(concat('page', '/', '_text_HTML', '/', '_media_web', '/', CAST(page_id AS STRING))) AS blob_key FROM pages"


def q_fetch_blobs_pages(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (pages,) = tables(spark, sf_dir, "pages")
    bk = blob_key(F.lit("page"), F.lit("_text_HTML"), F.lit("_media_web"), F.col("page_id").cast("string"))
    # every page three times: bare key, handle form, and a key that misses
    req = reduce(
        DataFrame.unionByName,
        [
            pages.select((F.col("page_id") * 3).alias("request_id"), bk.alias("key")),
            pages.select((F.col("page_id") * 3 + 1).alias("request_id"), F.concat(F.lit("blobs/"), bk).alias("key")),
            pages.select((F.col("page_id") * 3 + 2).alias("request_id"), F.md5("url").alias("key")),
        ],
    )
    out = fetch_blobs(req, d["blobs"])
    return out.select(
        *_long("request_id"), "key", "status", "_blob_identifier",
        F.length("_blob_content").cast("long").alias("content_chars"), F.md5("_blob_content").alias("content_md5"),
    )


ORACLE_FETCH_BLOBS = osql.with_(
    """
SELECT CAST(q.request_id AS BIGINT) AS request_id, q.key, CASE WHEN b._key IS NULL THEN 'not_found' ELSE 'ok' END AS status,
       b._blob_identifier, CAST(length(b._blob_content) AS BIGINT) AS content_chars, md5(b._blob_content) AS content_md5
FROM (
  SELECT page_id * 3 AS request_id, md5(concat('page/_text_HTML/_media_web/', CAST(page_id AS STRING))) AS key FROM pages
  UNION ALL SELECT page_id * 3 + 1, concat('blobs/', md5(concat('page/_text_HTML/_media_web/', CAST(page_id AS STRING)))) FROM pages
  UNION ALL SELECT page_id * 3 + 2, md5(url) FROM pages
) q LEFT JOIN blobs b ON b._key = regexp_replace(q.key, '^blobs/', '')"""
)
