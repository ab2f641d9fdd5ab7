"""Readers for the three dictionary collections.

Terms are schemaless JSON documents. They are read as text and parsed into
VARIANT, never through ``spark.read.json`` with an inferred schema: a struct
column cannot tell a missing key from a key holding JSON null, and the alias
rule depends on exactly that difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dictgraph.functions.variant import has_field, is_object
from dictgraph.functions.constants import ENGLISH

EDGE_SCHEMA = T.StructType(
    [
        T.StructField("_key", T.StringType()),
        T.StructField("_from", T.StringType()),
        T.StructField("_to", T.StringType()),
        T.StructField("_predicate", T.StringType()),
        T.StructField("_path", T.ArrayType(T.StringType())),
    ]
)

BLOB_SCHEMA = T.StructType(
    [
        T.StructField("_key", T.StringType()),
        T.StructField("_blob_item", T.StringType()),
        T.StructField("_blob_type", T.StringType()),
        T.StructField("_blob_kind", T.StringType()),
        T.StructField("_blob_identifier", T.StringType()),
        T.StructField("_blob_content", T.StringType()),
    ]
)


def terms_from_json(df: DataFrame, doc_col: str = "doc", key_col: str | None = "_key") -> DataFrame:
    """``(_key, doc VARIANT)`` from a DataFrame holding JSON text.

    Without a key column the key is taken from ``_code._gid`` (the dictionary
    guarantees ``_key == _code._gid``). Text that is no JSON object with a key
    is left out here and kept by ``rejected_terms``."""
    return _parsed(df, doc_col, key_col).filter(~_rejected()).select("_key", "doc")


def rejected_terms(df: DataFrame, doc_col: str = "doc", key_col: str | None = "_key") -> DataFrame:
    """``(_key, text)`` of the rows that ``terms_from_json`` leaves out."""
    return _parsed(df, doc_col, key_col).filter(_rejected()).select("_key", "text")


def _parsed(df: DataFrame, doc_col: str, key_col: str | None) -> DataFrame:
    doc = F.try_parse_json(F.col(doc_col))
    key = F.try_variant_get(doc, "$._code._gid", "string") if key_col is None else F.col(key_col)
    return df.select(key.alias("_key"), doc.alias("doc"), F.col(doc_col).alias("text"), F.spark_partition_id().alias(_PARSED))


# Where a document was parsed: conditions on a parsed document would be pushed
# before the parsing, which each of their terms would do once more.
_PARSED = "__parsed_in"


def _rejected():
    return F.col("_key").isNull() | F.col("doc").isNull() | ~is_object("doc") | (F.col(_PARSED) < 0)


def read_terms(spark: SparkSession, path: str, fmt: str = "jsonl") -> DataFrame:
    """Read terms from JSON lines (one document per line) or from Parquet
    holding ``(_key, doc)`` with ``doc`` as VARIANT or JSON text."""
    if fmt == "jsonl":
        return terms_from_json(spark.read.text(path).withColumnRenamed("value", "doc"), key_col=None)
    df = spark.read.parquet(path)
    if isinstance(df.schema["doc"].dataType, T.StringType):
        return terms_from_json(df)
    return df.select("_key", "doc")


def read_rejected_terms(spark: SparkSession, path: str) -> DataFrame:
    """``(_key, text)`` of the JSON lines that ``read_terms`` leaves out."""
    return rejected_terms(spark.read.text(path).withColumnRenamed("value", "doc"), key_col=None)


_BROKEN = "__broken"


def _json_lines(spark: SparkSession, path: str, schema: T.StructType, needed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines in ``schema``, and the text of the lines that give
    none: no JSON object, a field of another kind, or a needed field missing."""
    wide = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    lines = spark.read.text(path).select("value", F.from_json("value", wide, {"columnNameOfCorruptRecord": _BROKEN}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{_BROKEN}").isNotNull()
    for name in needed:
        bad = bad | F.col(f"r.{name}").isNull()
    return lines.filter(~bad).select(*[f"r.{f.name}" for f in schema.fields]), lines.filter(bad).select(F.col("value").alias("text"))


_EDGE_NEEDS = ("_key", "_from", "_to")
_BLOB_NEEDS = ("_key",)


def read_edges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Edges from Parquet or JSON lines. A line that is no edge (unreadable, or
    without key or ends) is left out and kept by ``read_rejected_edges``; an edge
    without predicate or path is read and never usable."""
    if fmt == "jsonl":
        return _json_lines(spark, path, EDGE_SCHEMA, _EDGE_NEEDS)[0]
    return spark.read.schema(EDGE_SCHEMA).parquet(path)


def read_rejected_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(text)`` of the JSON lines that ``read_edges`` leaves out."""
    return _json_lines(spark, path, EDGE_SCHEMA, _EDGE_NEEDS)[1]


def read_blobs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Blobs from Parquet or JSON lines; a line without a key is left out and
    kept by ``read_rejected_blobs``."""
    if fmt == "jsonl":
        return _json_lines(spark, path, BLOB_SCHEMA, _BLOB_NEEDS)[0]
    return spark.read.schema(BLOB_SCHEMA).parquet(path)


def read_rejected_blobs(spark: SparkSession, path: str) -> DataFrame:
    """``(text)`` of the JSON lines that ``read_blobs`` leaves out."""
    return _json_lines(spark, path, BLOB_SCHEMA, _BLOB_NEEDS)[1]


def prepare_terms(terms: DataFrame) -> DataFrame:
    """Derive the plain columns the hot operators use, once, at ingest.

    An alias shell is a document with neither ``_info`` nor ``_data``
    (present-with-null counts as present)."""
    if "is_alias" in terms.columns:
        return terms
    has_info = has_field("doc", "$._info")
    has_data = has_field("doc", "$._data")
    return terms.select(
        "_key",
        "doc",
        has_info.alias("has_info"),
        has_data.alias("has_data"),
        (~has_info & ~has_data).alias("is_alias"),
        F.try_variant_get("doc", f"$._info._title.{ENGLISH}", "string").alias("title_eng"),
    )
