"""Streaming use of the single-pass operators.

Literal validation (O4c), alias resolution (O1) and blob lookup (O8) are a
join of the request side with a static dictionary relation, so the request
side may be a Structured Streaming DataFrame: Spark plans a stream-static
join (left, left-semi and left-anti are all supported with the stream on
the left). Such a plan takes the dictionary as it was when the query was
defined: a plain file source lists its files once, and ``resolve_alias_stream``
resolves every key of the dictionary at that moment.

A dictionary that is replaced while the stream runs is followed by the
``…_each_batch`` functions, for ``foreachBatch``: every micro-batch reads the
tables as they are then (``current_table``), and only for its own distinct
keys, which are pushed into the published alias map, terms and blobs.

The looping operators (O3 expansion, O5 graph resolution) need actions per
hop and are batch-only; ``for_each_batch`` runs any batch operator on every
micro-batch through ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictgraph.functions.constants import BLOBS, NOT_FOUND, OK
from dictgraph.functions.keys import strip_collection
from dictgraph.operators.blobs import fetch_blobs
from dictgraph.operators.membership import validate_column
from dictgraph.operators.terms import resolve_alias, resolve_keys


def current_table(spark: SparkSession, name: str) -> DataFrame:
    """A table as it is now, also if it was replaced since it was last read."""
    spark.catalog.refreshTable(name)
    return spark.table(name)


def validate_stream(stream: DataFrame, code, root: str, edges: DataFrame, mode: str = "flag", **kw) -> DataFrame:
    """``validate_column`` on a streaming fact table (stream-static join)."""
    return validate_column(stream, code, root, edges, mode=mode, **kw)


def validate_each_batch(
    code,
    root: str,
    load_membership: Callable[[SparkSession], DataFrame],
    sink: Callable[[DataFrame, int], None],
    mode: str = "flag",
    **kw,
):
    """A ``foreachBatch`` function that validates every micro-batch against the
    membership relation as it is then: ``load_membership(spark)`` gives
    ``(leaf, root_h)``, for example from a published table."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        members = load_membership(batch.sparkSession)
        sink(validate_column(batch, code, root, None, mode=mode, membership=members, **kw), epoch_id)

    return run


def resolve_alias_stream(stream: DataFrame, terms: DataFrame, edges: DataFrame, gid_col: str = "gid") -> DataFrame:
    """O1 on a stream: the resolution of every dictionary key is the static
    side; stream rows pick theirs up by a left stream-static join."""
    keys = terms.select(F.col("_key").alias("gid"))
    answers = resolve_keys(keys, terms, edges, with_doc=False).withColumnRenamed("gid", gid_col)
    out = stream.join(answers, gid_col, "left")
    return out.withColumn("status", F.coalesce("status", F.lit(NOT_FOUND)))


def resolve_alias_each_batch(
    load: Callable[[SparkSession], tuple[DataFrame, DataFrame]],
    sink: Callable[[DataFrame, int], None],
    gid_col: str = "gid",
    with_doc: bool = False,
):
    """A ``foreachBatch`` function for O1 under a dictionary that changes:
    ``load(spark)`` gives the terms and the published alias map as they are at
    each micro-batch. Only the batch's distinct keys are looked up."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        terms, aliases = load(batch.sparkSession)
        sink(resolve_alias(batch, terms, None, gid_col=gid_col, with_doc=with_doc, alias_table=aliases), epoch_id)

    return run


def fetch_blobs_each_batch(load: Callable[[SparkSession], DataFrame], sink: Callable[[DataFrame, int], None], key_col: str = "key"):
    """A ``foreachBatch`` function for O8 under blobs that change: ``load(spark)``
    gives them as they are at each micro-batch; only its keys are looked up."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        sink(fetch_blobs(batch, load(batch.sparkSession), key_col=key_col), epoch_id)

    return run


def fetch_blobs_stream(stream: DataFrame, blobs: DataFrame, key_col: str = "key") -> DataFrame:
    """O8 on a stream of keys."""
    req = stream.withColumn("_key", strip_collection(F.col(key_col), BLOBS))
    out = req.join(blobs.withColumn("status", F.lit(OK)), "_key", "left")
    return out.withColumn("status", F.coalesce("status", F.lit(NOT_FOUND)))


def for_each_batch(operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """A ``foreachBatch`` function applying a batch operator per micro-batch."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        sink(operator(batch), epoch_id)

    return run
