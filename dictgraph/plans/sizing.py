"""Broadcast only behind a size check.

The check takes the rows and bytes of at most ``max_rows + 1`` rows of the
(usually filtered, already small) side. Beyond a bound the plain DataFrame is
returned and Spark plans a shuffle join; AQE may still turn it into a broadcast
from the runtime statistics of the shuffle, and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of narrow key tables (one or two short strings) that are safe to ship
# to every executor: ~1M keys is tens of MB.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000

# Bytes of a broadcast side whose rows carry documents (VARIANT payloads).
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024

# Rows of the multi-column loop state of the graph operators (frontier,
# visited set: ~100 bytes a row), i.e. about Spark's 10 MB broadcast default.
LOOP_MAX_BROADCAST_ROWS = 100_000


def is_bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> bool:
    """Whether a side is within both bounds: rows, and the bytes of its strings
    beside 16 for each column of a row."""
    if df.isStreaming:
        return False
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    row = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in text), F.lit(16 * len(df.columns)))
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= max_rows and found["bytes"] <= max_bytes


def broadcast_if_bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if is_bounded(df, max_rows) else df


def broadcast_small(df: DataFrame, known_rows: int, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose row count is already known (e.g. counted
    right after a checkpoint)."""
    return F.broadcast(df) if known_rows <= max_rows else df


def spread_if_narrow(df: DataFrame) -> DataFrame:
    """Round-robin repartition a scan that has fewer partitions than the
    cluster has task slots, before CPU-heavy per-row work (tokenizing text).
    A table of many files already arrives in many splits and is left as is."""
    if df.isStreaming:
        return df
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        narrow = df.rdd.getNumPartitions() < slots
    except Exception:  # Spark Connect exposes no partition count
        return df
    return _stay(df.repartition(slots)) if narrow else df


def _stay(dealt: DataFrame) -> DataFrame:
    """``dealt`` with a condition that always holds and that Spark cannot move.
    Other filters are pushed through a deal of rows, with all that they are made
    of (a parsed document, the words that an ``explode`` needs to be some): the
    work that the rows were dealt for would be done in the tasks before."""
    return dealt.filter(F.spark_partition_id() >= 0)


# Source rows from which one task derives dictionary rows.
ROWS_PER_TASK = 100_000


def spread_rows(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt evenly over as many tasks as its rows need, whatever the
    files and row groups it was read from. Counting a Parquet table reads its
    footers alone; select the needed columns first, they are what moves."""
    rows = df.count()
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # Spark Connect
        slots = 1
    tasks = max(-(-rows // rows_per_task), min(slots, -(-rows // (rows_per_task // 10))))
    if tasks < 2:
        return df
    # by the rows' places: no key can be hot, and nothing is sorted for it
    dealt = df.withColumn("__place", F.monotonically_increasing_id()).repartition(tasks, "__place")
    return _stay(dealt).drop("__place")
