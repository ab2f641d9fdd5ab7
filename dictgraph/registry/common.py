"""Shared pieces of the registered queries: the derived dictionary (checkpointed
once per session and data folder) and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dictgraph.plans.lineage import cut_lineage
from dictgraph.sources.derived import derive_dictionary, read_tables

_CACHE: dict[tuple, dict] = {}


def dictionary(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived dictionary, written once per session and data folder into
    the reliable checkpoint folder (the analogue of a loaded collection);
    blobs stay a lazy projection of ``pages`` so page content is not copied."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        app = spark.conf.get("spark.app.id", None) or str(id(spark))
    key = (app, sf_dir)
    if key not in _CACHE:
        d = derive_dictionary(spark, sf_dir)
        _CACHE[key] = {"terms": cut_lineage(d["terms"]), "edges": cut_lineage(d["edges"]), "blobs": d["blobs"]}
    return _CACHE[key]


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    t = read_tables(spark, sf_dir, names)
    return [t[n] for n in names]


def _long(*cols):
    return [F.col(c).cast("long").alias(c) for c in cols]


def endpoint_keys(edges: DataFrame, terms: DataFrame) -> DataFrame:
    ends = edges.select(F.expr("substr(_from, 7)").alias("gid")).union(edges.select(F.expr("substr(_to, 7)").alias("gid")))
    return ends.union(terms.select(F.col("_key").alias("gid"))).distinct()
