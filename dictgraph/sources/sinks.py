"""Result sinks: operator outputs as JSON lines or Parquet.

VARIANT columns (``doc``, ``term``) are rendered as JSON text for the JSON
sink, so every row becomes one JSON object like a response of the original
service; Parquet keeps VARIANT as is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def variants_as_json(df: DataFrame) -> DataFrame:
    """Replace every top-level VARIANT column by its JSON text."""
    cols = [
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.VariantType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    variants_as_json(df).write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by=None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
