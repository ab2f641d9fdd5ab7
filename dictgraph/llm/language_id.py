"""Language identification by prediction by partial matching."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dictgraph.llm.common import cut, most_frequent, release, ship_package, texts_of

ORDER = 3  # bytes of the longest context
SAMPLE_ROWS = 1_000  # different labelled texts a language is learned from, at most
GRAMS = 2_000_000  # most frequent (language, run of bytes) pairs that come to the driver
MODEL_BYTES = 64 << 20  # of the table of code lengths; the most frequent contexts that fit are kept
BROADCAST_LANGUAGES = 10_000
MIN_CONTEXT = 4  # a context seen less often is not in the tree
PIECE = 1 << 18  # bytes scored at a time


def grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ORDER + 1 bytes (before the text: zero bytes) as a number,
    the earliest byte highest, and how often it comes."""
    x = np.frombuffer(b"\0" * ORDER + data, np.uint8).astype(np.int64)
    n = len(x) - ORDER
    code = np.zeros(n, np.int64)
    for k in range(ORDER + 1):
        code = code << 8 | x[k : k + n]
    return np.unique(code, return_counts=True)


class Trees:
    """Context trees of all languages with frozen statistics.

    ``go`` leads from a context and a byte to the longest context in the tree
    that ends with that byte. ``bits`` is the code length of each byte after
    each context in each language: the byte's share where the language has seen
    it there, else an escape and the shorter context's code. The escape takes as
    many parts as the context has had different bytes.
    """

    def __init__(self, counts: dict[str, dict[int, int]], min_context: int = MIN_CONTEXT):
        self.languages = sorted(counts)
        used = sorted({c >> 8 * k & 0xFF for codes in counts.values() for c in codes for k in range(ORDER + 1)} | {0})
        # bytes that training never saw share the last symbol
        self.symbols = len(used) + 1
        self.symbol = np.full(256, len(used), np.uint8)
        self.symbol[used] = np.arange(len(used))
        size = self.symbols
        by_context: list[list[dict[tuple, np.ndarray]]] = []  # [language][order][context]
        total: dict[tuple, int] = {}
        for lang in self.languages:
            orders: list[dict[tuple, np.ndarray]] = [{} for _ in range(ORDER + 1)]
            for code, n in counts[lang].items():
                run = tuple(int(self.symbol[code >> 8 * k & 0xFF]) for k in range(ORDER, -1, -1))
                for k in range(ORDER + 1):
                    context = run[ORDER - k : ORDER]
                    if context not in orders[k]:
                        orders[k][context] = np.zeros(size, np.int64)
                    orders[k][context][run[ORDER]] += n
            by_context.append(orders)
            for order in orders:
                for context, row in order.items():
                    total[context] = total.get(context, 0) + int(row.sum())
        room = max(1, MODEL_BYTES // (4 * size * max(1, len(self.languages))))
        often = sorted((c for c, n in total.items() if n >= min_context), key=lambda c: (-total[c], len(c), c))
        kept = {*often[:room], ()}
        kept |= {c[i:] for c in kept for i in range(len(c))} | {c[:i] for c in kept for i in range(len(c))} | {()}
        self.contexts = sorted(kept, key=lambda c: (len(c), c))
        number = {c: i for i, c in enumerate(self.contexts)}
        go = np.zeros((len(self.contexts), size), np.int32)
        for i, c in enumerate(self.contexts):
            for s in range(size):
                run = (*c, s)[-ORDER:]
                while run not in number:
                    run = run[1:]
                go[i, s] = number[run]
        share = np.empty((len(self.contexts), size, len(self.languages)))
        for i, c in enumerate(self.contexts):
            shorter = share[number[c[1:]]] if c else np.full((size, len(self.languages)), 1 / (size + 255))
            if not c:
                shorter[-1] = 1 / (size + 255) / 256 * max(1, 256 - len(used))
            for j in range(len(self.languages)):
                row = by_context[j][len(c)].get(c)
                if row is None:
                    share[i, :, j] = shorter[:, j]
                else:
                    seen = np.count_nonzero(row)
                    n = row.sum()
                    share[i, :, j] = np.where(row > 0, row / (n + seen), seen / (n + seen) * shorter[:, j])
        self.go = go.ravel()
        self.bits = -np.log2(share).astype(np.float32).reshape(go.size, len(self.languages))

    def code_lengths(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """Bits of the texts that begin at ``starts`` of ``data`` (ORDER zero
        bytes stand before each), a row per text and a column per language."""
        x = self.symbol[np.frombuffer(data, np.uint8)]
        out = np.zeros((len(starts), len(self.languages)))
        ends = np.append(starts[1:] - ORDER, len(x))
        size = self.symbols
        for at in range(ORDER, len(x), PIECE):
            part = x[at - ORDER : at + PIECE].astype(np.int32)
            n = len(part) - ORDER
            state = np.zeros(n, np.int32)
            for k in range(ORDER):  # the context depends on the last ORDER bytes alone
                state = self.go[state * size + part[k : k + n]]
            bits = self.bits[state * size + part[ORDER:]]
            sums = np.vstack([np.zeros((1, bits.shape[1])), np.cumsum(bits, 0, dtype=np.float64)])
            first = max(0, np.searchsorted(starts, at, "right") - 1)
            last = np.searchsorted(starts, at + n, "left")
            lo, hi = (np.clip(p[first:last] - at, 0, n) for p in (starts, ends))
            out[first:last] += sums[hi] - sums[lo]
        return out


def _train(batches):
    for batch in batches:
        langs, codes, counts = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            code, n = grams(text.encode())
            langs += [lang] * len(code)
            codes.append(code)
            counts.append(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(langs, pa.string()),
                pa.array(np.concatenate([*codes, np.empty(0, np.int64)])),
                pa.array(np.concatenate([*counts, np.empty(0, np.int64)])),
            ],
            names=["lang", "code", "n"],
        )


def fit_languages(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text", lang_col: str = "lang") -> Trees:
    """Context trees from at most ``sample_rows`` different labelled texts of
    each language (those with the least hash), each read whole. Equal texts of a
    language count as one, so no group of copies fills a sample. The model is
    bounded by MODEL_BYTES whatever the number of languages and scripts. Rows
    without label or text teach nothing."""
    ship_package(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(
        "lang is not null and text is not null"
    )
    # a first cut by hash keeps about twice the sample, so that a common
    # language's texts are not all ranked
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
    few = sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("place", "text"))
    sample = (
        rows.withColumn("place", place)
        .join(F.broadcast(sizes) if few else sizes, "lang")
        .where(F.col("place") * F.col("texts") <= 2 * sample_rows + 20)
        .dropDuplicates(["lang", "text"])
        .withColumn("rank", rank)
        .where(F.col("rank") <= sample_rows)
        .select("lang", "text")
    )
    counts: dict[str, dict[int, int]] = {}
    found = sample.mapInArrow(_train, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    for r in most_frequent(cut(found), GRAMS, "code").collect():
        counts.setdefault(r.lang, {})[r.code] = r.n
    return Trees(counts)


def _predict(model, batches):
    release()
    trees = model.value
    for batch in batches:
        column = batch.column(1)
        texts = texts_of(column)
        data = [t.encode() for t in texts]
        starts = np.cumsum([ORDER, *(len(d) + ORDER for d in data[:-1])], dtype=np.int64)[: len(data)]
        if trees.languages:
            bits = trees.code_lengths(b"".join(b"\0" * ORDER + d for d in data), starts)
            best = bits.argmin(1)
            gap = np.minimum(bits - bits[np.arange(len(data)), best][:, None], 1000.0)
            score = 1 / np.exp2(-gap).sum(1)
        langs, scores, length = [], [], []
        for i, text in enumerate(texts):
            if trees.languages and any(map(str.isalpha, text)):
                langs.append(trees.languages[best[i]])
                scores.append(float(score[i]))
                length.append(float(bits[i, best[i]]) / len(data[i]))
            else:
                langs.append("und")
                scores.append(0.0)
                length.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(length, pa.float64())],
            names=[batch.schema.field(0).name, "lang_pred", "score", "bits_per_byte"],
        )


def predict_languages(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``id_col``, ``lang_pred``, ``score`` and ``bits_per_byte``.

    The whole text's exact code length under each language's frozen context
    tree is summed byte by byte; the shortest wins (ties: the first name). The
    score is the share of that language when each has weight 2 to the minus its
    code length. A null text, or one without a letter, is ``und`` with score 0,
    as is every text if no language was learned. Repeated rows and null ids are
    kept; an empty table gives an empty result. Very long texts are scored in
    pieces. No shuffle.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double"
    return rows.mapInArrow(partial(_predict, spark.sparkContext.broadcast(trees)), schema)


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of the id as text leaves no remainder (null ids: of
    the empty text)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == 0
