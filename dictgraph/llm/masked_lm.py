"""Masked pseudo-likelihood: every token predicted from both its sides."""

from __future__ import annotations

import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.llm.bpe import Memo
from dictgraph.llm.common import cut, most_frequent, release, ship_package, texts_of
from dictgraph.llm.decontaminate import words_of

SIDE = 2  # tokens read on each side
WORDS = 8_192  # frequent words with an input vector of their own
BUCKETS = 16  # rarer words share vectors by their last two bytes
CLASSES = 32  # frequent words are predicted by class, then within the class
WIDTH = 12  # numbers of an input vector
HIDDEN = 24
PARTS = 8  # rounds of a pass over all tokens, with the tasks' networks averaged after each
PASSES = 1
BATCH = 1024
RATE = 0.1
FLUSH = 250_000  # distinct words that a task counts before it hands them on
PIECE = 1 << 13  # tokens scored at a time, so that their numbers stay in the cache


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


class Vocabulary:
    """Token ids, classes and shares within classes from corpus counts.

    Ids: frequent words, then buckets, then the place beyond a text's ends.
    Frequent words fall into CLASSES by rank, each with about the same sum of
    root counts; every bucket is a class of its own, shared evenly by its
    distinct words and one unseen.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], bucket_types: list[int]):
        self.ids = {w: i for i, (w, _) in enumerate(frequent)}
        self.n_words = len(frequent)
        self.outside = self.n_words + BUCKETS
        self.n_classes = CLASSES + BUCKETS
        counts = np.array([n for _, n in frequent], float)
        mass = np.cumsum(np.sqrt(counts))
        classes = np.minimum((mass - 1e-9) * CLASSES / (mass[-1] if len(mass) else 1), CLASSES - 1).astype(np.int64)
        total = np.bincount(classes, counts, CLASSES)
        self.class_of = np.concatenate([classes, CLASSES + np.arange(BUCKETS)])
        self.log_share = np.concatenate([np.log(counts / total[classes]), -np.log(np.array(bucket_types) + 1.0)])

    def encode(self, words: list[bytes], memo: Memo) -> np.ndarray:
        """Ids of a text with SIDE places beyond each end."""
        out = np.full(len(words) + 2 * SIDE, self.outside, np.int64)
        out[SIDE : SIDE + len(words)] = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        return out

    def id_of(self, word: bytes | None) -> int:
        if word is None:
            return self.outside
        found = self.ids.get(word)
        return self.n_words + bucket_of(word) if found is None else found


_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]


def bounded(z: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Scores whose exponentials are finite: less their row's greatest, where the
    weights (of inputs between -1 and 1) allow scores that are too large."""
    if (np.abs(w2).sum(0) + np.abs(b2)).max() > 80:
        z -= z.max(1, keepdims=True)
    return z


class Network:
    """Window network: input vectors of the neighbours, one hidden layer, and
    a softmax over the classes of the word between them."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays

    @classmethod
    def fresh(cls, vocabulary: Vocabulary, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        vectors = (0.3 * rng.standard_normal((vocabulary.outside + 1, WIDTH))).astype(np.float32)
        k = vocabulary.n_classes
        return cls([vectors, normal(2 * SIDE * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), normal(HIDDEN, k), np.zeros(k, np.float32)])

    def gradients(self, around: np.ndarray, classes: np.ndarray):
        """Mean loss of windows and its gradients; those of the vectors as rows
        for each neighbour."""
        vectors, w1, b1, w2, b2 = self.arrays
        x = vectors.take(around.ravel(), axis=0).reshape(len(around), -1)
        h = np.tanh(x @ w1 + b1)
        p = np.exp(bounded(h @ w2 + b2, w2, b2))
        p /= p.sum(1, keepdims=True)
        at = np.arange(len(classes))
        loss = -np.log(p[at, classes] + 1e-30).mean()
        p[at, classes] -= 1
        p /= len(classes)
        back = (p @ w2.T) * (1 - h * h)
        return loss, (back @ w1.T).reshape(-1, WIDTH), [x.T @ back, back.sum(0), h.T @ p, p.sum(0)]

    def train(self, windows: np.ndarray, class_of: np.ndarray, seed: int) -> None:
        """One pass over windows (SIDE ids, the word, SIDE ids) in an order that
        the seed gives; steps shrink with each weight's past gradients."""
        vectors = self.arrays[0]
        past = [np.full_like(a, 1e-6) for a in self.arrays]
        windows = windows[np.random.default_rng(seed).permutation(len(windows))]
        sides = [SIDE + k for k in _OFFSETS]
        for at in range(0, len(windows), BATCH):
            rows = windows[at : at + BATCH].astype(np.int64)
            around = rows[:, sides]
            _, g_rows, grads = self.gradients(around, class_of[rows[:, SIDE]])
            flat = around.ravel()
            by_id = np.argsort(flat.astype(np.int16), kind="stable")  # ids have 15 bits
            flat = flat[by_id]
            first = np.flatnonzero(np.diff(flat, prepend=-1))
            used = flat[first]
            g = np.add.reduceat(g_rows.take(by_id, axis=0), first, axis=0)  # of all places of an id together
            seen = past[0].take(used, axis=0) + g * g
            past[0][used] = seen
            vectors[used] = vectors.take(used, axis=0) - RATE * g / np.sqrt(seen)
            for a, s, d in zip(self.arrays[1:], past[1:], grads):
                s += d * d
                a -= RATE * d / np.sqrt(s)

    def pack(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.arrays]).astype(np.float32).tobytes()

    def unpack(self, data: bytes) -> Network:
        flat, at, out = np.frombuffer(data, np.float32), 0, []
        for a in self.arrays:
            out.append(flat[at : at + a.size].reshape(a.shape).copy())
            at += a.size
        return Network(out)

    def tables(self) -> list[np.ndarray]:
        """Each neighbour's share of the hidden layer's input, by place and id."""
        vectors, w1 = self.arrays[:2]
        return [vectors @ w1[i * WIDTH : (i + 1) * WIDTH] for i in range(2 * SIDE)]


class Scorer:
    """Conditional log-probabilities under a trained network."""

    def __init__(self, vocabulary: Vocabulary, network: Network):
        self.vocabulary = vocabulary
        self.places = network.tables()
        _, _, self.b1, self.w2, self.b2 = network.arrays
        self.memo = Memo(vocabulary.id_of)

    def token_scores(self, words: list[bytes]) -> np.ndarray:
        """log P(word | SIDE words before and after) for every word."""
        return self.scores_of(self.vocabulary.encode(words, self.memo))[SIDE : SIDE + len(words)]

    def scores_of(self, ids: np.ndarray) -> np.ndarray:
        """The same for the places of encoded texts on end; 0 at the places beyond
        their ends."""
        v = self.vocabulary
        out = np.zeros(len(ids))
        for at in range(SIDE, len(ids) - SIDE, PIECE):
            n = min(PIECE, len(ids) - SIDE - at)
            h = np.broadcast_to(self.b1, (n, HIDDEN)).copy()
            for table, k in zip(self.places, _OFFSETS):
                h += table.take(ids[at + k : at + k + n], axis=0)
            z = bounded(np.tanh(h, out=h) @ self.w2 + self.b2, self.w2, self.b2)
            own = ids[at : at + n]
            word = np.minimum(own, v.outside - 1)
            picked = z[np.arange(n), v.class_of[word]].astype(float)
            score = picked - np.log(np.exp(z, out=z).sum(1).astype(float)) + v.log_share[word]
            out[at : at + n] = np.where(own == v.outside, 0.0, score)
        return out


def _count(batches):
    release()
    seen: Counter[bytes] = Counter()

    def rows():
        words = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array(map(bucket_of, words), pa.int32())],
            names=["word", "n", "bucket"],
        )

    for batch in batches:
        for text in texts_of(batch.column(0)):
            seen.update(words_of(text.encode()))
            if len(seen) > FLUSH:
                yield rows()
                seen.clear()
    yield rows()


def fit_vocabulary(texts: DataFrame, words: int = WORDS) -> Vocabulary:
    """Counts of every word of all texts (``text``): the ``words`` most frequent
    come to the driver, the rest as a number of distinct words per bucket."""
    counts = cut(texts.mapInArrow(_count, "word binary, n long, bucket int").groupBy("word", "bucket").agg(F.sum("n").alias("n")))
    top = [(bytes(r.word), r.n, r.bucket) for r in most_frequent(counts, words, "word").collect()]
    types = [0] * BUCKETS
    for r in counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("types")).collect():
        types[r.bucket] = r.types
    for _, _, b in top:
        types[b] -= 1
    return Vocabulary([(w, n) for w, n, _ in top], types)


def _encoded(vocabulary, batches):
    """Each row's id and its text's ids with the places beyond both ends, as
    bytes: on end they are the texts with such places between them."""
    release()
    v = vocabulary.value
    memo = Memo(v.id_of)
    for batch in batches:
        ids = [v.encode(words_of(t.encode()), memo).astype(np.int16).tobytes() for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])


def _on_end(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16)


def windows_of(ids: np.ndarray, outside: int, part: int) -> np.ndarray:
    """The windows (SIDE ids, a token, SIDE ids) of every PARTS-th place from
    ``part`` on; over all parts each token has one."""
    if len(ids) < 2 * SIDE + 1:
        return np.empty((0, 2 * SIDE + 1), ids.dtype)
    found = np.lib.stride_tricks.sliding_window_view(ids, 2 * SIDE + 1)[part::PARTS]
    return found[found[:, SIDE] != outside]


def _train(vocabulary, start, round_no, batches):
    """The task's network after its windows, with their number."""
    release()
    v = vocabulary.value
    network = Network.fresh(v) if start is None else Network.fresh(v).unpack(start.value)
    seen = 0
    for batch in batches:
        ids = _on_end(batch.column(0))
        windows = windows_of(ids, v.outside, round_no % PARTS)
        if len(windows):
            network.train(windows, v.class_of, zlib.crc32(ids.tobytes()) + round_no)
            seen += len(windows)
    if seen:
        data = network.pack()
        yield pa.RecordBatch.from_arrays(
            [pa.array([zlib.crc32(data)], pa.int64()), pa.array([float(seen)]), pa.array([data], pa.binary())], names=["g", "n", "weights"]
        )


def _average(batches):
    """Weighted mean of the networks that arrive, one at a time."""
    total, mean = 0.0, None
    for batch in batches:
        for n, data in zip(batch.column(1).to_pylist(), batch.column(2)):
            flat = np.frombuffer(data.as_buffer(), np.float32)
            total += n
            mean = flat.astype(float) if mean is None else mean + (flat - mean) * (n / total)
    if mean is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int64()), pa.array([total]), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["g", "n", "weights"]
        )


def encoded_texts(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` (an id and a text) with their tokens' ids, written: two bytes a
    token, read by every round and by the scoring."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    return cut(rows.mapInArrow(partial(_encoded, shared), f"id {rows.schema[0].dataType.simpleString()}, ids binary"))


def fit_network(encoded: DataFrame, vocabulary: Vocabulary, passes: int = PASSES) -> Network:
    """Trained on every token of all ``encoded`` texts, ``passes`` times. A pass has PARTS
    rounds, each on the tokens of its own places. In a round every task trains
    the common network on its own windows; their weighted mean, taken in two
    steps so that no task sees all of them, is the next common network."""
    sc = encoded.sparkSession.sparkContext
    shared = sc.broadcast(vocabulary)
    encoded = encoded.select("ids")
    network = Network.fresh(vocabulary)
    start = None
    schema = "g long, n double, weights binary"
    tasks = encoded.rdd.getNumPartitions()
    meet = max(1, int(tasks**0.5))
    for k in range(passes * PARTS):
        trained = encoded.mapInArrow(partial(_train, shared, start, k), schema)
        some = trained.repartition(meet, "g").mapInArrow(_average, schema)
        last = some.repartition(1).mapInArrow(_average, schema).collect()
        if not last:  # no token at these places
            continue
        start = sc.broadcast(bytes(last[0].weights))
        network = network.unpack(start.value)
    return network


def _score(name, model, batches):
    release()
    scorer = Scorer(*model.value)
    for batch in batches:
        sizes = np.array([len(x) // 2 for x in batch.column(1).to_pylist()], np.int64)
        scores = scorer.scores_of(_on_end(batch.column(1)))
        starts = np.cumsum(sizes) - sizes
        n = sizes - 2 * SIDE
        if len(sizes):
            total, least = np.add.reduceat(scores, starts), np.minimum.reduceat(scores, starts)
        else:
            total = least = np.empty(0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(total), pa.array(least, mask=n == 0)], names=[name, "n_tokens", "log_likelihood", "least_token"]
        )


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, passes: int = PASSES) -> DataFrame:
    """Every row's ``id_col``, ``n_tokens``, ``log_likelihood`` (the sum of all
    tokens' log-probabilities given the tokens on both sides, natural log),
    ``mean_log_likelihood`` and ``least_token`` (the lowest of them).

    Tokens are runs of letters, digits and bytes above 127, A-Z in lower case.
    Word counts come from all texts, and the network is trained on every token
    of all texts; both are learned from ``docs`` themselves. Words that are
    equally frequent come into the vocabulary by their own order.

    A null or empty text has no tokens, a sum of 0 and a null mean; repeated
    rows and null ids are kept, one result each; an empty table gives an empty
    result. Texts are scored in pieces, whatever their length, and not shuffled.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = fit_vocabulary(rows.select("text"), words)
    encoded = encoded_texts(rows, vocabulary)
    model = spark.sparkContext.broadcast((vocabulary, fit_network(encoded, vocabulary, passes)))
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, log_likelihood double, least_token double"
    return encoded.mapInArrow(partial(_score, id_col, model), schema).withColumn(
        "mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    )
