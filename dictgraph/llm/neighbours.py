"""Approximate nearest neighbours by multi-index hashing of rotated binary codes."""

from __future__ import annotations

import math
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dictgraph.llm.common import cut, release, ship_package

BITS = 64  # bits of a code; fewer where vectors have fewer components
SAMPLE = 16_384  # rows that the rotation and the radius are learned from
CALIBRATION = 512  # of them, rows whose true neighbours in the sample set the radius
RECALL = 0.97  # share of these neighbours that the radius must reach
ROTATIONS = 50  # steps that fit the rotation
INDEX_ROWS = 65_536  # rows that a task indexes at a time
QUERY_BLOCK = 4_096  # queries that one pass over the rows answers
WIDEN = 8  # bits by which the radius grows for queries that found too few


class Codes:
    """Binary codes: signs of the centred, projected and rotated vector."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, radius: int):
        self.mean, self.axes, self.radius = mean, axes, radius
        self.bits = axes.shape[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        signs = (x - self.mean) @ self.axes > 0
        return signs @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))


def fit_codes(sample: np.ndarray, bits: int = BITS, k: int = 10, recall: float = RECALL) -> Codes:
    """Principal axes of the sample, turned so that the signs lose least of the
    projected vectors (alternating signs and orthogonal fits); the radius is the
    least one that holds a share ``recall`` of the sample's own neighbours. In
    all rows neighbours are at least as near as in the sample."""
    sample = np.unique(sample, axis=0)  # copies would teach a radius of 0
    mean = sample.mean(axis=0)
    centred = sample - mean
    bits = min(bits, sample.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    flat = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
    for _ in range(ROTATIONS):
        left, _, right = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (left @ right).T
    codes = Codes(mean, axes @ turn, bits)
    known = codes(sample)
    seen = np.zeros(bits + 1, np.int64)
    some = np.linspace(0, len(sample) - 1, min(CALIBRATION, len(sample))).astype(int)
    for i in some:
        d = ((sample - sample[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        seen += np.bincount(np.bitwise_count(known[near] ^ known[i]), minlength=bits + 1)
    if seen.sum():
        codes.radius = int(np.searchsorted(np.cumsum(seen), recall * seen.sum()))
    return codes


class MultiIndex:
    """Codes indexed by each of their substrings.

    Substrings have about as many bits as the number of rows, so that a bucket
    holds few. By the pigeonhole principle a code within ``m * a + b`` bits of
    another (b < m) is within ``a`` bits in one of the first b + 1 substrings,
    or within ``a - 1`` in one of the others."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes = codes
        m = min(bits, max(1, round(bits / max(1.0, math.log2(len(codes))))))
        ends = np.linspace(0, bits, m + 1).astype(int)
        self.parts = []
        for lo, hi in zip(ends, ends[1:]):
            sub = (codes >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)
            order = np.argsort(sub, kind="stable")
            values, starts = np.unique(sub[order], return_index=True)
            self.parts.append((int(lo), int(hi - lo), sub, order, values, np.append(starts, len(codes))))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits."""
        a, b = divmod(radius, len(self.parts))
        found, done = [], []
        for j, (lo, width, sub, order, values, starts) in enumerate(self.parts):
            reach = a if j <= b else a - 1
            if reach < 0:
                break
            own = (code >> np.uint64(lo)) & np.uint64((1 << width) - 1)
            at = _buckets(values, own, width, reach)
            size = starts[at + 1] - starts[at]
            shift = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(at) else np.empty(0, np.int64)
            rows = order[shift + np.arange(len(shift))]
            for other, there, most in done:  # a row is taken where it is first found
                rows = rows[np.bitwise_count(other[rows] ^ there) > most]
            found.append(rows[np.bitwise_count(self.codes[rows] ^ code) <= radius])
            done.append((sub, own, reach))
        return np.concatenate(found)


def _buckets(values: np.ndarray, own: np.uint64, width: int, reach: int) -> np.ndarray:
    """Places of the bucket values within ``reach`` bits of ``own``: each such
    value is looked up, or all are compared where there are fewer of those."""
    reach = min(reach, width)
    if sum(math.comb(width, i) for i in range(reach + 1)) >= len(values):
        return np.flatnonzero(np.bitwise_count(values ^ own) <= reach)
    flips = [sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(width), n)]
    probes = np.sort(np.array(flips, np.uint64) ^ own)
    at = np.searchsorted(values, probes)
    at[at == len(values)] = 0
    return at[values[at] == probes]


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _nearest(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least distances, ties to the smaller id."""
    if len(d) > k:
        few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        few = np.arange(len(d))
    return few[np.lexsort((ids[few], d[few]))][:k]


def _search(codes: Codes, queries, radius: int, k: int, batches):
    """The ``k`` nearest rows of a task for each query, among the rows whose
    codes lie within ``radius`` bits."""
    release()
    query_ids, vectors = queries.value
    width = vectors.shape[1]
    query_codes = codes(vectors)
    best = [(np.empty(0, np.int64), np.empty(0)) for _ in query_ids]

    def answer(ids: np.ndarray, x: np.ndarray) -> None:
        index = MultiIndex(codes(x), codes.bits)
        for q, (own, code) in enumerate(zip(query_ids, query_codes)):
            rows = index.within(code, radius)
            rows = rows[ids[rows] != own]
            d = np.sqrt(((x[rows] - vectors[q]) ** 2).sum(axis=1))
            near = _nearest(ids[rows], d, k)
            all_ids, all_d = np.concatenate([best[q][0], ids[rows][near]]), np.concatenate([best[q][1], d[near]])
            at = _nearest(all_ids, all_d, k)
            best[q] = all_ids[at], all_d[at]

    waiting, n = [], 0
    for batch in batches:
        waiting.append((batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), width)))
        n += batch.num_rows
        if n >= INDEX_ROWS:
            answer(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
            waiting, n = [], 0
    if n:
        answer(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(query_ids, [len(b[0]) for b in best]), pa.int64()),
            pa.array(np.concatenate([b[0] for b in best]), pa.int64()),
            pa.array(np.concatenate([b[1] for b in best]), pa.float64()),
        ],
        names=["query_id", "vec_id", "score"],
    )


def usable(vector: Column) -> Column:
    """Whether a vector can take part: no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bits: int = BITS,
    recall: float = RECALL,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (Euclidean
    distance in double precision) of the ``k`` nearest rows found of ``vectors``
    for every row of ``queries``, nearest first, ties to the smaller id.

    Codes are signs of rotated vectors, learned from about SAMPLE rows; every
    row is indexed, in blocks of INDEX_ROWS where it lies, by each substring of
    its code. A block of queries goes to all tasks, and every code within the
    learned radius is found by the pigeonhole principle and reranked on the
    floats. Queries that find fewer than ``k`` rows are asked again with a wider
    radius, in the end with one that holds all rows. Only the ``k`` best rows of
    a task and query are shuffled.

    Rows with a null id, and vectors that are null, empty, zero or hold a null
    or non-finite component take no part; nor do vectors without the most
    common number of components (ties: the least). Rows with a query's id are
    no neighbours of it. Repeated rows are rows of their own; of several query
    rows with one id the least vector is asked. Empty tables give an empty
    result.
    """
    spark = vectors.sparkSession
    ship_package(spark)

    def prepared(df: DataFrame) -> DataFrame:
        kind = df.schema[vector_col].dataType.simpleString()
        vector = F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
        return rows.where(F.col("id").isNotNull() & usable(F.col("vector")))

    rows, asked = prepared(vectors), prepared(queries)
    sizes = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    size = sizes.agg(F.max_by(F.struct("width", "n"), F.struct("n", -F.col("width"))).alias("s")).select("s.*").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size.width is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == size.width)
    asked = cut(asked.where(F.size("vector") == size.width).groupBy("id").agg(F.min("vector").alias("vector")))
    n_asked = asked.count()

    share = int(min(1.0, SAMPLE / size.n) * (1 << 40))
    sample = rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 40)) < share).select("vector").toArrow()
    sample = _matrix(sample.column(0).combine_chunks(), size.width)
    if not n_asked or not len(sample):
        sample = np.eye(size.width)
    codes = fit_codes(sample, bits, k, recall)

    parts = []
    blocks = max(1, math.ceil(n_asked / query_block))
    for block in range(blocks if n_asked else 0):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        ids, x = own.column(0).to_numpy(), _matrix(own.column(1).combine_chunks(), size.width)
        radius = codes.radius
        while len(ids):
            packed = spark.sparkContext.broadcast((ids, x))
            found = rows.mapInArrow(partial(_search, codes, packed, radius, k), "query_id long, vec_id long, score double")
            found = cut(_top(found, k))
            enough = found.where(F.col("rank") == k).select("query_id").toArrow().column(0).to_numpy()
            if radius >= codes.bits:
                enough = ids
            parts.append(found.join(F.broadcast(spark.createDataFrame([(int(i),) for i in enough], "query_id long")), "query_id", "left_semi"))
            left = ~np.isin(ids, enough)
            ids, x, radius = ids[left], x[left], min(codes.bits, radius + WIDEN)
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)
