"""Lineage cuts for iterative operators.

Every hop of a graph loop is written with ``checkpoint()`` into the
session's reliable checkpoint folder (``spark.checkpoint.dir``), so a lost
executor costs one hop, not a replay of the whole loop, and plans stay flat.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from dictgraph.session import ensure_checkpoint_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpoint and return the row count, observed while the checkpoint
    job runs (no second job)."""
    ensure_checkpoint_dir(df.sparkSession)
    obs = Observation("dg_" + uuid.uuid4().hex)
    out = df.observe(obs, F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    return out, int(obs.get["rows"])


def cut_lineage_observed(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """Checkpoint and return ``rows`` plus the named aggregate ``metrics``
    (Column expressions), all observed during the checkpoint job."""
    ensure_checkpoint_dir(df.sparkSession)
    obs = Observation("dg_" + uuid.uuid4().hex)
    cols = [F.count(F.lit(1)).alias("rows")] + [c.alias(name) for name, c in metrics.items()]
    out = df.observe(obs, *cols).checkpoint(eager=True)
    return out, dict(obs.get)
