"""Corpus pipeline: from the documents table to token ids.

Each stage works on all rows its predecessor kept, is written as Parquet and
read again as the next one's documents; all but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictgraph.llm.bpe_codec import encode_texts
from dictgraph.llm.chosen_path import keep_one_of_each
from dictgraph.llm.common import table
from dictgraph.llm.decontaminate import remove_contamination
from dictgraph.llm.pii import pseudonymise_documents
from dictgraph.llm.quality import keep_quality
from dictgraph.llm.queries import BYTE_BPE, pii_key
from dictgraph.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rewritten(docs: DataFrame) -> DataFrame:
    """``docs`` after their texts were changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no outliers of their language and source."""
    return keep_quality(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word n-grams at 0.8 or more."""
    return keep_one_of_each(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans they share with benchmark items; rows that are
    such spans almost wholly go."""
    return _rewritten(remove_contamination(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal numbers, dates and addresses."""
    return _rewritten(pseudonymise_documents(docs.select(COLUMNS), pii_key(spark)))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text decoded from them."""
    return encode_texts(docs.select(COLUMNS), public_tokenizers.path(BYTE_BPE), memo_bytes=16 << 20)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("BPE encoding and decoding", bpe),
]

# SQL cannot express the stages (iterated estimates, automata, permutations,
# merges); tests/llm/test_pipeline.py holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from the documents in ``sf_dir``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
