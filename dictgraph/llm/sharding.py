"""Contiguous shards of near-equal byte size by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dictgraph.llm.common import cut


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into one of ``shards`` shards that are contiguous in the
    order of ``id_col`` and whose sizes are near equal (law ``bytes``).

    Returns ``id_col``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``,
    ``shard``, ``slot`` (place in the shard, from 0) and ``grown_shard`` (null:
    only key laws have one).

    Only ids, sizes and checksums move. They are ranged by id; each partition's
    total and row count give its offset (a running sum over as many rows as
    there are partitions), a sort inside the partition gives the rest, and a
    row belongs to the shard whose equal target holds the middle of its bytes.
    Every cut is thus off its target by half a row at most.

    A null text has size 1; null ids come first. Rows of equal id are ordered
    by checksum and size, so that many rows of one id still spread over
    partitions; equal rows are counted once while ranging and expanded at the
    end, so that they do not meet in one task either. An empty table gives an
    empty result.
    """
    order = ["_id", "text_crc32", "size"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    equal = rows.groupBy(*order).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(equal.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    # one row per partition, so this window over all of them stays small
    running = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("rows"))
    offsets = offsets.select(
        "part",
        F.coalesce(F.sum("bytes").over(running), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(running), F.lit(0)).alias("rows_before"),
    )
    total = ranged.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 1
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("_b", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0)))
        .withColumn("_r", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "part")  # a row per partition
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("rank", F.col("rows_before") + F.col("_r") + F.col("copy"))
        .withColumn("middle", F.col("bytes_before") + F.col("_b") + F.col("copy") * F.col("size") + F.expr("size div 2"))
        .withColumn("shard", F.least(F.expr(f"(middle * {int(shards)}) div {int(total)}"), F.lit(shards - 1)).cast("int"))
        .select("_id", "size", "text_crc32", "shard", "rank")
    )
    placed = cut(placed)
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))  # a row per shard
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
