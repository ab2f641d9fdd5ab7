"""Token counts by byte-pair merging, without emitting identifiers."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.llm import bpe
from dictgraph.llm.common import held, ship_package, texts_of

def count_text(text: str, merges: bpe.Merges, memo: bpe.Memo) -> int:
    total = 0
    for i, part in enumerate(merges.sections(text)):
        total += 1 if i % 2 else sum(map(memo.__getitem__, bpe.split_words(part)))
    return total


def _counter(data: bytes):
    merges = bpe.Merges(data)
    return merges, bpe.Memo(merges.count)


def _count(vocabulary, batches):
    merges, memo = held(("token counts", hash(vocabulary.value)), lambda: _counter(vocabulary.value))
    for batch in batches:
        texts = texts_of(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x.encode()) for x in texts], pa.int64()),
                pa.array([count_text(x, merges, memo) for x in texts], pa.int64()),
            ],
            names=[batch.schema.field(0).name, "n_bytes", "n_tokens"],
        )


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every
    row's whole text, as the tokenizers library counts them for the file at
    ``vocabulary_path`` (a byte-level BPE) without begin or end tokens.

    Each piece of the text starts as its bytes; the lowest-rank adjacent pair
    is popped from a heap and joined in a linked list until none is left, and
    the count is the bytes less the merges. An added token written in the text
    counts as one, as in the library.

    A null text counts as empty (0, 0, false); repeated rows and null ids are
    kept, one result each; an empty table gives an empty result. The work of a
    row depends on that row alone: no shuffle.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary_path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(partial(_count, vocabulary), schema).withColumn("over_limit", F.col("n_tokens") > limit)
