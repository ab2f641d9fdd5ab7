"""BPE encoding and decoding with a lexicon of the corpus' frequent words."""

from __future__ import annotations

from array import array
from collections import Counter
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.llm import bpe, lexicon
from dictgraph.llm.common import at_end, cut, held, most_frequent, release, ship_file, ship_package, texts_of

# A word is a candidate if some task sees it in this share of its own words.
# Every word with that share of the whole corpus has it in at least one task,
# so no such word is missed, and a task sends at most 1 / SHARE rows.
SHARE = 5e-6
# Words in the lexicon. It only decides how a word's ids are found, never which.
LEXICON_WORDS = 32_768
# What a worker remembers of words' ids.
MEMO_BYTES = 192 << 20


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, merges: bpe.Merges, words: lexicon.Lexicon | None, memo_bytes: int = MEMO_BYTES):
        self.merges, self.words = merges, words
        self.memo = bpe.Memo(self._packed, memo_bytes)

    def _packed(self, word: str) -> bytes:
        ids = self.words.ids(word.encode()) if self.words is not None else None
        return array("i", self.merges.encode(word) if ids is None else ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        out: list[bytes] = []
        for i, part in enumerate(self.merges.sections(text)):
            if i % 2:
                out.append(array("i", [self.merges.special[part]]).tobytes())
            else:
                out.extend(map(self.memo.__getitem__, bpe.split_words(part)))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        """As the library: bytes that are no UTF-8 give U+FFFD."""
        return b"".join(map(self.merges.id_bytes.__getitem__, ids)).decode("utf-8", "replace")


def _candidates(batches):
    """Counts of a task's frequent words, as pieces with their leading space."""
    release()
    seen: Counter[bytes] = Counter()
    total, room = 0, 300_000
    floor = 0
    for batch in batches:
        for text in texts_of(batch.column(0)):
            words = text.encode().split()
            total += len(words)
            seen.update(words)
            if len(seen) > room:  # lossy counting: what is dropped has at most `floor` more
                floor += 1
                seen = Counter({w: c for w, c in seen.items() if c > floor})
                room = max(room, 2 * len(seen))
    found: Counter[str] = Counter()
    for word, n in seen.items():
        if n + floor >= max(2, SHARE * total) and len(word) <= 64:
            for piece in bpe.split_words(" " + word.decode("utf-8", "replace")):
                found[piece] += n
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(found.keys()), pa.string()), pa.array(list(found.values()), pa.int64())], names=["piece", "n"]
    )


def frequent_words(docs: DataFrame, size: int = LEXICON_WORDS, text_col: str = "text") -> DataFrame:
    """The ``size`` most frequent pieces (``piece``, ``n``) over all texts."""
    ship_package(docs.sparkSession)
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(_candidates, "piece string, n long")
    return most_frequent(cut(found.groupBy("piece").agg(F.sum("n").alias("n"))), size, "piece")


def build_lexicon(docs: DataFrame, vocabulary: bytes, size: int = LEXICON_WORDS, text_col: str = "text") -> bytes:
    """Transducer block for the frequent words; ``size`` bounds what the driver holds."""
    merges = bpe.Merges(vocabulary)
    words = [r.piece for r in frequent_words(docs, size, text_col).collect()]
    return lexicon.build({w.encode(): merges.encode(w) for w in words})


def codec(vocabulary: bytes, block_name: str | None, memo_bytes: int) -> Codec:
    """The worker's codec; the lexicon file is memory-mapped where Spark put it."""

    def make() -> Codec:
        words = lexicon.Lexicon(SparkFiles.get(block_name)) if block_name else None
        return Codec(bpe.Merges(vocabulary), words, memo_bytes)

    return held(("codec", hash(vocabulary), block_name, memo_bytes), make)


def _encode(vocabulary, block_name, memo_bytes, digests, batches):
    coder = codec(vocabulary.value, block_name, memo_bytes)
    for batch in at_end(batches):
        column = batch.column(1)
        n, ids, decoded = [], [], []
        for i in range(len(column)):  # one text at a time, as its parts take many times its size
            found = coder.encode(column[i].as_py() or "")
            n.append(len(found))
            listed = found.tolist()
            back = coder.decode(listed)
            if digests:
                ids.append(sha256(",".join(map(str, listed)).encode()).hexdigest())
                decoded.append(sha256(back.encode()).hexdigest())
            else:
                ids.append(found)
                decoded.append(back)
        if digests:
            ids = pa.array(ids, pa.string())
        else:
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        names = [batch.schema.field(0).name, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), ids, pa.array(decoded, pa.string())], names=names)


def encode_texts(
    docs: DataFrame,
    vocabulary_path: str,
    lexicon_words: int = LEXICON_WORDS,
    digests: bool = False,
    memo_bytes: int = MEMO_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids`` and ``decoded`` of every row's whole
    text (with ``digests``: SHA-256 of the comma-joined ids and of the decoded
    text instead), as the tokenizers library gives them for the byte-level BPE
    at ``vocabulary_path`` without begin or end tokens.

    The frequent words of all texts are compiled with their ids into a minimal
    acyclic transducer; Spark hands its file to every executor, where workers
    memory-map it. Other words are merged pair by pair. Decoding joins the
    bytes of the ids. A worker remembers words' ids in about ``memo_bytes``,
    which decides its memory and never the result.

    A null text counts as empty (no ids, empty text); repeated rows and null
    ids are kept, one result each; of words that are equally frequent the least
    in order come into the lexicon; an empty table gives an empty result. A very
    long text is held whole by its task, with its ids.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary_path, "rb") as f:
        data = f.read()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    block = build_lexicon(rows, data, lexicon_words, text_col)
    name = ship_file(spark, "lexicon", block)
    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, {out}"
    return rows.mapInArrow(partial(_encode, spark.sparkContext.broadcast(data), name, memo_bytes, digests), schema)
