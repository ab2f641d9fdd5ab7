"""Registered queries of the subpackage: one ``opN_<name>`` per operator, over
the whole of its table and with production parameters."""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictgraph.llm.bpe_codec import encode_texts
from dictgraph.llm.chosen_path import similarity_join
from dictgraph.llm.common import table
from dictgraph.llm.decontaminate import find_contamination, items_digest
from dictgraph.llm.language_id import fit_languages, held_out, predict_languages
from dictgraph.llm.lexical import ranked_search
from dictgraph.llm.license_texts import KNOWN
from dictgraph.llm.licenses import blocks_sql, canonical_sql, known_licenses, license_scan
from dictgraph.llm.masked_lm import pseudo_likelihood
from dictgraph.llm.neighbours import nearest_neighbours
from dictgraph.llm.pii import pii_report
from dictgraph.llm.quality import quality_rules
from dictgraph.llm.runs import periodic_runs
from dictgraph.llm.sharding import shard_by_bytes
from dictgraph.llm.token_count import count_tokens

BYTE_BPE = "byte_bpe_50k.json"


_made_keys: dict[str, bytes] = {}


def pii_key(spark: SparkSession) -> bytes:
    """The secret of the pseudonyms: ``spark.dictgraph.pii.key``. Without it a
    random one is made for the application: values are then linked within its
    runs, and nobody can undo them afterwards."""
    key = spark.conf.get("spark.dictgraph.pii.key", None)
    if key:
        return key.encode()
    return _made_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses replaced."""
    return pii_report(table(spark, sf_dir, "documents"), pii_key(spark))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics of every document and whether it is kept."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licenses that every document, a line or a run of paragraphs of it equals."""
    found = license_scan(table(spark, sf_dir, "documents"), known_licenses(spark))
    return found.select("doc_id", "digest", "license_id", *[F.array_join(c, ",").alias(c) for c in ("notices", "passages")])


def op5_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document by 5-word n-grams."""
    return similarity_join(table(spark, sf_dir, "documents"))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of near-equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by heap-and-linked-list merging."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), digests=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    trees = fit_languages(docs.where(~held_out(F.col("doc_id"))))
    found = predict_languages(docs, trees)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        items_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_hit",
    )


def op11_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    found = ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where every text whose id's CRC-32 ten divides
    repeats some of its own words from one word on, as the query's contract says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    rows = docs.select("doc_id", "text", h.alias("h")).select("doc_id", "text", F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, words).alias("words"))
    rows = rows.withColumn("a", F.expr("cast(if(size(words) > 0, g % size(words), null) as int)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (size(words) - a) div (3 + g % 8) as int)"))
    planted = F.expr("array_join(concat(slice(words, 1, a), transform(sequence(a, size(words) - 1), i -> words[a + (i - a) % p])), ' ')")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, with planted ones."""
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("b", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("b.start")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found of every vector whose id 100 divides."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


_ALL = (
    op1_pii_pseudonyms,
    op2_quality_rules,
    op3_masked_lm,
    op4_license_scan,
    op5_chosen_path_join,
    op6_byte_shards,
    op7_token_counts,
    op8_bpe_codec,
    op9_language_id,
    op10_decontamination,
    op11_norm_bucket_search,
    op12_periodic_runs,
    op13_multi_index_hashing,
)
QUERIES = {f.__name__: f for f in _ALL}

# DuckDB SQL of the queries that SQL can express over whole tables.
_KNOWN_ROWS = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in KNOWN)
ORACLE: dict[str, str] = {
    "op4_license_scan": f"""
WITH known(license_id, text) AS (VALUES {_KNOWN_ROWS}),
names AS (SELECT sha256(c) AS digest, min(license_id) AS license_id
          FROM (SELECT license_id, {canonical_sql("text")} AS c FROM known) WHERE c <> '' GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, sha256({canonical_sql("line")}) AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
found AS (SELECT r, list_sort(list(DISTINCT license_id)) AS notices FROM lines JOIN names USING (digest) GROUP BY r),
whole AS (SELECT r, doc_id, sha256({canonical_sql("text")}) AS digest FROM docs),
texts AS (SELECT d, min(license_id) AS license_id FROM (SELECT license_id, {blocks_sql("text")} AS d FROM known) WHERE len(d) > 0 GROUP BY d),
parts AS (SELECT license_id, d, len(d) AS n, unnest(d) AS digest, generate_subscripts(d, 1) AS j FROM texts),
doc_parts AS (SELECT r, unnest(d) AS digest, generate_subscripts(d, 1) AS place FROM (SELECT r, {blocks_sql("text")} AS d FROM docs)),
runs AS (SELECT DISTINCT r, license_id FROM (SELECT r, license_id, d, n, place - j AS start, count(DISTINCT j) AS matched
           FROM doc_parts JOIN parts USING (digest) GROUP BY ALL) WHERE matched = n
         UNION SELECT r, license_id FROM whole JOIN names USING (digest)),
passages AS (SELECT r, list_sort(list(DISTINCT license_id)) AS passages FROM runs GROUP BY r)
SELECT whole.doc_id, whole.digest, names.license_id, coalesce(array_to_string(found.notices, ','), '') AS notices,
       coalesce(array_to_string(passages.passages, ','), '') AS passages
FROM whole LEFT JOIN names USING (digest) LEFT JOIN found ON found.r = whole.r LEFT JOIN passages ON passages.r = whole.r
""",
    "op11_norm_bucket_search": r"""
WITH d AS (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents) WHERE len(t) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
items AS (SELECT DISTINCT q, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS q, item_id,
            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark)),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
       WHERE term IN (SELECT term FROM items) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf, total GROUP BY term, n_docs),
scores AS (SELECT q, item_id, r, doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM tf JOIN w USING (term) JOIN items USING (term), total GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
""",
}
