"""Numbers for rows in the order of their keys, without a global sort in one task.

Rows are dealt by ranges of the keys and sorted inside each range; a row's
number is the count of rows in earlier ranges plus its place in its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.plans.lineage import cut_lineage

# monotonically_increasing_id: the partition above this bit, the place below.
_PLACE_BITS = 33


def ordered_ids(df: DataFrame, keys: Sequence[str], name: str, num_ranges: int | None = None) -> DataFrame:
    """``df`` with the long ``name`` that ascends with ``keys`` (with gaps from
    one range to the next). To be written before it is read twice."""
    ranged = df.repartitionByRange(*([num_ranges] if num_ranges else []), *keys).sortWithinPartitions(*keys)
    return ranged.withColumn(name, F.monotonically_increasing_id())


def number_rows(df: DataFrame, keys: Sequence[str], name: str = "row", num_ranges: int | None = None) -> DataFrame:
    """``df`` with the long ``name``: 0, 1, 2, ... in ascending order of ``keys``
    (nulls first; the order of equal keys is left open). The rows come back in
    that order, partition by partition."""
    rows = cut_lineage(ordered_ids(df, keys, "__at", num_ranges))
    part = F.shiftrightunsigned("__at", _PLACE_BITS)
    # one row a partition: bounded by the number of ranges, not by the data
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    side = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    place = F.col("__at") - F.shiftleft(part, _PLACE_BITS)
    return rows.join(side, part == F.col("__part")).withColumn(name, F.col("__before") + place).drop("__at", "__part", "__before")
