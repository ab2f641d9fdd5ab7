"""Ranked lexical search: impact vectors in buckets of like length.

The score of a document for an item is the inner product of the document's
impact vector (weight times saturated frequency of each term) with the item's
0/1 vector. A few items share a vocabulary; over it, vectors are ordered by
length, and a bucket of vectors no longer than some length is passed over for
an item where that length times the item's cannot reach the item's best scores
so far.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dictgraph.llm.common import cut, release, ship_package

BLOCK_TERMS = 200_000  # terms of the items that one pass over the documents answers
SEEDS = 4_096  # longest vectors that are scored first
GROUP = 4  # items that share a vocabulary
BUCKET = 512  # vectors of one bucket
CELLS = 1 << 20  # groups times vectors that a task orders at a time

# Letters and digits of ASCII and all other code points are parts of terms;
# only A to Z are lower-cased.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _texts(column) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _item_terms(batches):
    release()
    for batch in batches:
        terms = [sorted(set(terms_of(t))) for t in _texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["q", "terms"])


def _frequencies(vocabulary, batches):
    """Each text's number of terms, and the vocabulary's terms in it with their
    frequencies; texts without a term are left out."""
    release()
    number = {t: i for i, t in enumerate(vocabulary.value)}
    for batch in batches:
        sizes, ends, terms, counts = [], [0], [], []
        for text in _texts(batch.column(1)):
            words = terms_of(text)
            seen = Counter(filter(None.__ne__, map(number.get, words)))
            sizes.append(len(words))
            terms += seen.keys()
            counts += seen.values()
            ends.append(len(terms))
        ends = pa.array(ends, pa.int32())
        out = pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
            ],
            names=["id", "n", "terms", "counts"],
        )
        yield out.filter(pa.array(np.array(sizes, np.int64) > 0))


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Starts (one more than rows) and values of a list column."""
    starts = column.offsets.to_numpy()
    return starts - starts[0], column.flatten().to_numpy()


def _impacts(weight, n_docs: int, n_terms: int, batches):
    """Impacts of the terms and the length of the vector of them."""
    release()
    weight = weight.value
    for batch in batches:
        starts, terms = _lists(batch.column(2))
        tf = _lists(batch.column(3))[1].astype(np.int64)
        m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
        impact = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(starts))))
        row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        squares = np.bincount(row, impact.astype(np.float64) ** 2, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.sqrt(squares)),
                batch.column(2),
                pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(impact)),
            ],
            names=["id", "length", "terms", "impacts"],
        )


class ByTerm:
    """Owners (groups, or items) of each term."""

    def __init__(self, pairs, n_terms: int):
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.starts, self.owners = np.searchsorted(pairs[:, 0], np.arange(n_terms + 1)), pairs[:, 1]

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``terms``, owner) for every owner of a term."""
        size = self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(np.arange(len(terms)), size)
        return at, self.owners[_ranges(self.starts[terms], size)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Group:
    """Items that share a vocabulary, which is numbered from 0 here; the rarest
    half of an item's terms, its coordinates that are looked at first, are apart
    from the rest."""

    def __init__(self, first: int, items: list[np.ndarray], weight: np.ndarray):
        self.first = first  # the number of its first item
        self.terms = np.unique(np.concatenate(items))
        self.size = np.array([len(t) for t in items], np.int64)
        self.n_rest = self.size // 2
        early, late = [], []
        for q, terms in enumerate(items):
            order = np.searchsorted(self.terms, terms[np.argsort(-weight[terms], kind="stable")])
            half = len(order) - len(order) // 2
            early += [(t, q) for t in order[:half]]
            late += [(t, q) for t in order[half:]]
        self.early, self.late = ByTerm(early, len(self.terms)), ByTerm(late, len(self.terms))


class Block:
    """The groups of a block of items."""

    def __init__(self, items: list[np.ndarray], weight: np.ndarray, group: int):
        self.n = len(items)
        self.groups = [Group(s, items[s : s + group], weight) for s in range(0, len(items), group)]
        self.by_term = ByTerm([(t, g) for g, own in enumerate(self.groups) for t in own.terms], len(weight))


class Best:
    """The ``k`` best documents of each item, and the score that one must reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.astype(np.float64)
        self.rows: list[list[tuple]] = [[] for _ in least]

    def add(self, q: int, scores: np.ndarray, ids: list) -> None:
        if len(scores) > self.k:
            few = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
            scores, ids = scores[few], [ids[i] for i in few.tolist()]
        new = [(-s, i is None, i if i is not None else 0, i) for s, i in zip(scores.tolist(), ids)]
        self.rows[q] = sorted(self.rows[q] + new, key=lambda r: r[:3])[: self.k]
        if len(self.rows[q]) == self.k:
            self.least[q] = max(self.least[q], -self.rows[q][-1][0])


def scan_bucket(items: Group, best: Best, ids: list, length: np.ndarray, row: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> int:
    """Score one bucket of vectors over a group's terms (``length`` descending;
    ``row``, ``terms`` and ``impacts`` of their coordinates). Returns how many
    pairs the bounds left, -1 if the bucket can win for no item."""
    least = best.least[items.first : items.first + len(items.size)]
    alive = np.sqrt(items.size) * length[0] * (1 + 1e-9) + 1 >= least  # Cauchy-Schwarz for the whole bucket
    if not alive.any():
        return -1
    n, cells = len(length), len(items.size) * len(length)
    at, q = items.early.of(terms)
    cell, x = q * n + row[at], impacts[at]
    score = np.zeros(cells, np.int64)
    np.add.at(score, cell, x)
    squares = np.bincount(cell, x.astype(np.float64) ** 2, minlength=cells).reshape(-1, n)
    left = np.maximum(length[None, :] ** 2 * (1 + 1e-9) - squares, 0)
    bound = score.reshape(-1, n) + np.sqrt(items.n_rest[:, None] * left)
    maybe = (bound * (1 + 1e-9) + 1 >= least[:, None]) & (bound > 0) & alive[:, None]
    some = maybe.any(axis=0)[row]
    at, q = items.late.of(terms[some])
    own_row, x = row[some][at], impacts[some][at]
    inside = maybe[q, own_row]
    np.add.at(score, q[inside] * n + own_row[inside], x[inside])
    score = score.reshape(-1, n)
    good = maybe & (score > 0) & (score >= least[:, None])
    for q in np.flatnonzero(good.any(axis=1)).tolist():
        at = np.flatnonzero(good[q])
        best.add(items.first + q, score[q, at], [ids[i] for i in at.tolist()])
    return int(maybe.sum())


def scan(block: Block, best: Best, ids: list, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, bucket: int = BUCKET) -> int:
    """Score vectors given by rows (``starts``) of ``terms`` and ``impacts``.
    Returns how many pairs of item and vector the bounds left."""
    n = len(ids)
    row = np.repeat(np.arange(n), np.diff(starts))
    at, group = block.by_term.of(terms)
    cell = group * n + row[at]  # a vector's coordinates of a group
    sizes = np.bincount(cell, minlength=len(block.groups) * n)
    lengths = np.sqrt(np.bincount(cell, impacts[at].astype(np.float64) ** 2, minlength=len(sizes)))
    begins = np.cumsum(sizes) - sizes
    at = at[np.argsort(cell, kind="stable")]
    seen = 0
    for g, items in enumerate(block.groups):
        length = lengths[g * n : (g + 1) * n]
        own = np.argsort(-length, kind="stable")[: np.count_nonzero(length)]
        for s in range(0, len(own), bucket):
            rows = own[s : s + bucket]
            count = sizes[g * n + rows]
            places = at[_ranges(begins[g * n + rows], count)]
            local = np.searchsorted(items.terms, terms[places])
            left = scan_bucket(items, best, [ids[i] for i in rows.tolist()], length[rows], np.repeat(np.arange(len(rows)), count), local, impacts[places])
            if left < 0:  # later buckets are shorter still
                break
            seen += left
    return seen


def _search(packed, k: int, id_type, batches):
    release()
    block, least = packed.value
    best = Best(k, least)
    rows = max(1, CELLS // len(block.groups))
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            part = batch.slice(s, rows)
            starts, terms = _lists(part.column(2))
            scan(block, best, part.column(0).to_pylist(), starts, terms, _lists(part.column(3))[1])
    out = [(q, r[3], -r[0]) for q, rows in enumerate(best.rows) for r in rows]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], id_type), pa.array([r[2] for r in out], pa.int64())],
        names=["own", "id", "score"],
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("own").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rank_block(rows: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """``q``, ``rank``, ``id``, ``score`` of one block of items ``(q, terms)``."""
    spark = rows.sparkSession
    vocabulary = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    id_type = rows.schema[0].dataType.simpleString()
    packed = spark.sparkContext.broadcast(vocabulary)
    counted = cut(rows.mapInArrow(partial(_frequencies, packed), f"id {id_type}, n long, terms array<int>, counts array<int>"))
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total.docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # one row for each term of the block
        df[r.t] = r["count"]
    weight = weights(total.docs, df)
    impacts = counted.mapInArrow(
        partial(_impacts, spark.sparkContext.broadcast(weight), total.docs, total.terms),
        f"id {id_type}, length double, terms array<int>, impacts array<long>",
    )
    impacts = cut(impacts.where("length > 0"))

    step = F.floor(F.log2("length") * 16)
    histogram = impacts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("step")).collect()
    from_step, seen = 0, 0
    for r in histogram:  # some hundred rows at most
        from_step, seen = r.step, seen + r.rows
        if seen >= SEEDS:
            break
    wanted = Block([np.array([number[t] for t in terms], np.int64) for _, terms in items], weight, GROUP)

    def search(vectors: DataFrame, least: np.ndarray) -> DataFrame:
        given = spark.sparkContext.broadcast((wanted, least))
        id_arrow = pa.schema(rows.limit(0).select("id").toArrow().schema).field(0).type
        found = vectors.mapInArrow(partial(_search, given, k, id_arrow), f"own long, id {id_type}, score long")
        return _ranked(found, k)

    least = np.zeros(len(items), np.int64)
    for r in search(impacts.where(step >= from_step), least).where(F.col("rank") == k).select("own", "score").toLocalIterator():
        least[r.own] = r.score
    names = spark.createDataFrame([(i, int(q)) for i, (q, _) in enumerate(items)], "own long, q long")
    return cut(search(impacts, least)).join(F.broadcast(names), "own").select("q", "rank", "id", "score")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k``
    highest-scoring documents of every item (fewer where fewer score above 0),
    equal scores by ascending id.

    Terms are what is left of a text when ASCII other than letters and digits
    is cut out, A to Z lower-cased. Score, weights and saturation are integers
    (README); the search is exact. Items are answered in blocks of about
    ``block_terms`` terms, which all tasks get. A pass over the documents counts
    their terms. The longest impact vectors of all are scored first, which gives
    each item a score to reach. Then every task goes through its vectors, for
    each GROUP of items in buckets of falling length over the group's terms: a
    bucket whose longest vector cannot reach an item's score (Cauchy-Schwarz) is
    passed over for the item, and so is what follows; inside, the sum over the
    rarer half of the item's terms plus the bound on the rest decides; survivors
    are scored exactly. A task returns ``k`` rows an item at most, none that
    score less than the first ones did.

    A null or empty text has no terms: such a document counts nowhere and such
    an item has no rows. Repeated rows are rows of their own, documents and
    items alike. A null document id comes last among equal scores. Empty tables
    give an empty result; other columns take no part. A very long text is held
    by its task, a very long item by all.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = cut(items.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")))
    terms = cut(asked.select("q", "text").mapInArrow(_item_terms, "q long, terms array<binary>").where(F.size("terms") > 0))
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_terms))
    found = []
    for block in range(blocks):
        own = [(r.q, [bytes(t) for t in r.terms]) for r in terms.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()]  # about block_terms terms
        part = _rank_block(rows, own, k) if own else None
        if part is not None:
            found.append(part)
    item_type, id_type = asked.schema["item"].dataType.simpleString(), rows.schema[0].dataType.simpleString()
    if not found:
        return spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, `{id_col}` {id_type}, score long")
    return (
        reduce(DataFrame.unionByName, found)
        .join(asked.select("q", "item"), "q")
        .select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
    )
