"""Registered queries of the search surfaces and the list view (O10–O14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dictgraph import oracle_sql as osql
from dictgraph.functions.stemming import stem_sql, with_stems
from dictgraph.functions.tokens import word_tokens
from dictgraph.operators.search import (
    domain_filter,
    domain_index,
    identifier_index,
    identifier_search,
    segment_index,
    segment_search,
    term_list_view,
    text_index,
    text_index_frame,
    phrase_search_texts,
    query_tokens,
    stemmed,
    text_search,
)

from dictgraph.registry.common import _long, dictionary, tables

# ------------------------------------------------------------------ O10 – O14


def q_segment_search_phrase(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (nation,) = tables(spark, sf_dir, "nation")
    q = nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("text"))
    return segment_search(segment_index(d["terms"]), q, "phrase")


def q_segment_search_all(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (region,) = tables(spark, sf_dir, "region")
    q = region.select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.col("r_regionkey").cast("string"), F.lit("_geo")).alias("text"))
    return segment_search(segment_index(d["terms"]), q, "all")


def q_segment_search_any(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (nation,) = tables(spark, sf_dir, "nation")
    q = nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("code_"), F.col("n_nationkey").cast("string")).alias("text"))
    return segment_search(segment_index(d["terms"]), q, "any")


_SEG_POSTINGS = """
seg AS (
  SELECT _key AS gid, tok, CAST(pos AS BIGINT) AS pos FROM (
    SELECT _key, unnest(list_filter(split(_key, '_'), lambda x: x <> '')) AS tok,
           generate_subscripts(list_filter(split(_key, '_'), lambda x: x <> ''), 1) AS pos FROM terms)
)"""

ORACLE_SEGMENT_PHRASE = osql.with_(
    """
SELECT DISTINCT CAST(n.n_nationkey AS BIGINT) AS query_id, a.gid
FROM nation n JOIN seg a ON a.tok = 'nation' JOIN seg b ON b.gid = a.gid AND b.pos = a.pos + 1 AND b.tok = CAST(n.n_nationkey AS STRING)""",
    extra=_SEG_POSTINGS,
)

ORACLE_SEGMENT_ALL = osql.with_(
    """
SELECT DISTINCT CAST(r.r_regionkey AS BIGINT) AS query_id, a.gid
FROM region r JOIN seg a ON a.tok = CAST(r.r_regionkey AS STRING) JOIN seg b ON b.gid = a.gid AND b.tok = 'geo'""",
    extra=_SEG_POSTINGS,
)

ORACLE_SEGMENT_ANY = osql.with_(
    """
SELECT DISTINCT CAST(n.n_nationkey AS BIGINT) AS query_id, s.gid
FROM nation n JOIN seg s ON s.tok IN ('code', CAST(n.n_nationkey AS STRING))""",
    extra=_SEG_POSTINGS,
)


def q_identifier_search(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (nation,) = tables(spark, sf_dir, "nation")
    q = nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("value"), F.lit(None).cast("string").alias("field")).unionByName(
        nation.select((F.col("n_nationkey") + 1000).cast("long").alias("query_id"), F.col("n_nationkey").cast("string").alias("value"), F.lit("_aid").alias("field"))
    )
    return identifier_search(identifier_index(d["terms"]), q)


ORACLE_IDENTIFIER = osql.with_(
    """
SELECT DISTINCT q.query_id, '_aid' AS field, t._key AS gid
FROM (SELECT CAST(n_nationkey AS BIGINT) AS query_id, n_name AS value FROM nation
      UNION ALL SELECT CAST(n_nationkey + 1000 AS BIGINT), CAST(n_nationkey AS STRING) FROM nation) q
JOIN (SELECT _key, unnest(json_extract_string(doc, '$._code._aid[*]')) AS v FROM terms) t ON t.v = q.value"""
)


def q_text_search_titles(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (part,) = tables(spark, sf_dir, "part")
    q = part.select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()
    return text_search(text_index(d["terms"]), q, "all").withColumnRenamed("doc", "gid")


ORACLE_TEXT_TITLES = osql.with_(
    """
SELECT DISTINCT q.p_name AS query_id, t._key AS gid
FROM (SELECT DISTINCT p_name FROM part) q
JOIN (SELECT _key, regexp_extract_all(lower(json_extract_string(doc, '$._info._title.ISO_639_3_eng')), '[\\p{L}\\p{N}]+') AS toks FROM terms) t
  ON len(regexp_extract_all(lower(q.p_name), '[\\p{L}\\p{N}]+')) > 0
 AND list_has_all(t.toks, regexp_extract_all(lower(q.p_name), '[\\p{L}\\p{N}]+'))"""
)


def q_text_search_documents(spark, sf_dir):
    documents, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    q = benchmark.select(F.col("item_id").alias("query_id"), "text")
    out = phrase_search_texts(documents, q, "doc_id", "text")
    return out.select(*_long("query_id"), F.col("doc").cast("long").alias("doc_id"))


ORACLE_TEXT_DOCUMENTS = """
WITH d AS (SELECT doc_id, concat(' ', array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' '), ' ') AS norm FROM documents),
     b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS toks FROM benchmark)
SELECT CAST(b.item_id AS BIGINT) AS query_id, CAST(d.doc_id AS BIGINT) AS doc_id
FROM b JOIN d ON len(b.toks) > 0 AND contains(d.norm, concat(' ', array_to_string(b.toks, ' '), ' '))"""


def q_text_search_folded(spark, sf_dir):
    """Every benchmark passage as a phrase without accents and in small letters,
    in documents indexed the same way."""
    documents, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    upper = F.translate("text", "éèêüaeiou", "eeeuAEIOU")  # asked without some accents and partly in capitals
    q = benchmark.select(F.col("item_id").alias("query_id"), upper.alias("text"))
    index, pairs = (text_index_frame(documents, "doc_id", "text", fold=True, pairs=p) for p in (False, True))
    out = text_search(index, q, "phrase", pairs=pairs, fold=True)
    return out.select(*_long("query_id"), F.col("doc").cast("long").alias("doc_id"))


ORACLE_TEXT_FOLDED = """
WITH d AS (SELECT doc_id, concat(' ', array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' '), ' ') AS norm FROM documents),
     b AS (SELECT item_id, regexp_extract_all(strip_accents(lower(translate(text, 'éèêüaeiou', 'eeeuAEIOU'))), '[\\p{L}\\p{N}]+') AS toks FROM benchmark)
SELECT DISTINCT CAST(b.item_id AS BIGINT) AS query_id, CAST(d.doc_id AS BIGINT) AS doc_id
FROM b JOIN d ON len(b.toks) > 0 AND contains(d.norm, concat(' ', array_to_string(b.toks, ' '), ' '))"""


def q_text_search_stemmed(spark, sf_dir):
    """Documents that have the stems of all words of a benchmark passage."""
    documents, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    q = benchmark.select(F.col("item_id").alias("query_id"), "text")
    asked = stemmed(query_tokens(q, word_tokens)).select("token")
    index = stemmed(text_index_frame(documents, "doc_id", "text"), wanted=asked)
    out = text_search(index, q, "all", stem=True)
    return out.select(*_long("query_id"), F.col("doc").cast("long").alias("doc_id"))


ORACLE_TEXT_STEMMED = f"""
WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM documents),
     b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM benchmark),
     words AS (SELECT token FROM d UNION SELECT token FROM b),
     stems AS ({stem_sql("words")}),
     ds AS (SELECT DISTINCT doc_id, stem FROM d JOIN stems USING (token)),
     bs AS (SELECT DISTINCT item_id, stem FROM b JOIN stems USING (token)),
     need AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT CAST(item_id AS BIGINT) AS query_id, CAST(doc_id AS BIGINT) AS doc_id
FROM (SELECT item_id, doc_id, count(*) AS n FROM bs JOIN ds USING (stem) GROUP BY item_id, doc_id) JOIN need USING (item_id, n)"""


def q_stems(spark, sf_dir):
    """The stem of every distinct word of the documents."""
    (documents,) = tables(spark, sf_dir, "documents")
    words = text_index_frame(documents, "doc_id", "text").select("token").distinct()
    return with_stems(words)


ORACLE_STEMS = f"""
WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM documents)
{stem_sql("words")}"""


def q_domain_filter(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (part,) = tables(spark, sf_dir, "part")
    brands = part.select("p_brand").distinct()
    q = brands.select(F.col("p_brand").alias("query_id"), F.lit("brand").alias("path"), F.col("p_brand").alias("value")).unionByName(
        brands.select(F.col("p_brand").alias("query_id"), F.lit("_term_role").alias("path"), F.lit("item").alias("value"))
    )
    return domain_filter(domain_index(d["terms"]), q)


ORACLE_DOMAIN = osql.with_(
    """
SELECT DISTINCT json_extract_string(doc, '$._domn.brand') AS query_id, _key AS gid
FROM terms
WHERE json_extract_string(doc, '$._domn.brand') IS NOT NULL
  AND list_contains(json_extract_string(doc, '$._domn._term_role[*]'), 'item')"""
)


def q_term_list_view(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    v = term_list_view(d["terms"], order="gid")
    return v.select("gid", "nid", "title", F.array_join("term_roles", ",").alias("term_roles"))


ORACLE_TERM_LIST = osql.with_(
    """
SELECT _key AS gid, json_extract_string(doc, '$._code._nid') AS nid,
       json_extract_string(doc, '$._info._title.ISO_639_3_eng') AS title,
       CASE WHEN json_extract(doc, '$._domn._term_role') IS NULL THEN NULL
            ELSE array_to_string(json_extract_string(doc, '$._domn._term_role[*]'), ',') END AS term_roles
FROM terms ORDER BY gid"""
)
