"""Similarity join of word n-gram sets by chosen paths."""

from __future__ import annotations

import math
from functools import partial, reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.llm.common import cut, release, ship_package, texts_of
from dictgraph.llm.decontaminate import words_of

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 64  # minhash values that stand for a set in the paths
FANOUT = 2  # coordinates on which a large bucket is split
TARGET_RECALL = 0.99995  # for a pair right at the threshold, over the spread of its coordinates
BUCKET = 64  # a bucket up to this size is compared at once
BLOCK = 1024  # sets of a larger one that meet in one comparison
SLACK = 0.25  # share of agreeing coordinates below the threshold that is still verified
BROADCAST_KEYS = 500_000  # rows of about 50 bytes

_rng = np.random.default_rng(20240229)
_WORD_FACTORS = _rng.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(0, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def stays_together(t: float, fanout: int = FANOUT) -> float:
    """Probability that a pair with a share ``t`` of agreeing coordinates meets in
    a leaf of one run, however deep: the first coordinate agrees with probability
    t; below it the pair survives with the s that solves s = 1 - (1 - t s) ** fanout."""
    s = 1.0
    for _ in range(1000):
        s = 1 - (1 - t * s) ** fanout
    return t * s


def recall_of(runs: int, threshold: float = THRESHOLD, fanout: int = FANOUT) -> float:
    """Probability that a pair right at the threshold meets in some leaf. All runs
    draw on the same COORDINATES, of which a binomial number agrees, so it is the
    mean over that number; a pair with fewer agreeing ones than ``_least`` asks
    for is not verified either."""
    total = 0.0
    for k in range(_least(), COORDINATES + 1):
        share = math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k)
        total += share * (1 - (1 - stays_together(k / COORDINATES, fanout)) ** runs)
    return total


def runs_needed(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, fanout: int = FANOUT) -> int:
    """The least number of runs with the wanted recall at the threshold."""
    runs = 1
    while recall_of(runs, threshold, fanout) < recall:
        runs += 1
        if runs > 200:
            raise ValueError("so few coordinates cannot give this recall")
    return runs


def _least() -> int:
    """Agreeing coordinates from which on a pair is verified."""
    return math.floor((THRESHOLD - SLACK) * COORDINATES)


def shingles(words: list[bytes]) -> np.ndarray:
    """The set's distinct n-grams as sorted hashes; a text of fewer words, but
    not none, is one n-gram."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n] * _WORD_FACTORS[k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(grams: np.ndarray) -> np.ndarray:
    """Least hash of the set under each of COORDINATES functions."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048]
        out = np.minimum(out, (part[None, :] * _FACTORS[:, None] >> np.uint64(32)).min(1))
    return out.astype(np.uint32).view(np.int32)


def _sketches(batches):
    release()
    for batch in batches:
        keys, sizes, rows = [], [], []
        for text in texts_of(batch.column(2)):
            words = words_of(text.encode())
            grams = shingles(words)
            keys.append(md5(b" ".join(words)).hexdigest() if words else None)
            sizes.append(len(grams))
            rows.append(sketch(grams) if words else None)
        flat = np.concatenate([r for r in rows if r is not None] + [np.empty(0, np.int32)])
        offsets = np.cumsum([0] + [0 if r is None else COORDINATES for r in rows], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(keys, pa.string()),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.array([None if r is None else r.astype(np.uint8).tobytes() for r in rows], pa.binary()),
            ],
            names=["_id", "text_key", "key", "n", "sketch", "low"],
        )


def _leaves(sets: DataFrame, total: int, runs: int) -> DataFrame:
    """(leaf, key, n) of the chosen-path trees: ``n`` sets share the path.

    A run starts with one coordinate; a bucket is the sets that agree on it.
    Buckets of one set end, small ones are leaves, larger ones are split on
    FANOUT coordinates that the path's hash chooses, unless the last split left
    more than half of its bucket together: these sets are alike, and more
    splitting would only copy them (also pages of one template, 0.62 alike:
    splitting 600 of them down to BUCKET makes 167 million comparisons, where
    all pairs are 180 thousand)."""
    roots = [F.struct(F.xxhash64(F.lit(r), F.col("sketch")[r % COORDINATES]).alias("path")) for r in range(runs)]
    level = sets.select("key", F.explode(F.array(*roots)).alias("r")).select("r.path", "key", F.lit(total).cast("long").alias("above"))
    found = []
    while True:
        level = cut(level)
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        level = cut(level.join(sizes, "path"))
        done = (F.col("n") <= BUCKET) | (F.col("n") * 2 > F.col("above"))
        found.append(level.where(done).select(F.col("path").alias("leaf"), "key", "n"))
        wide = level.where(~done)
        if wide.isEmpty():
            return reduce(DataFrame.unionByName, found)
        at = [F.pmod(F.xxhash64("path", F.lit(k)), F.lit(COORDINATES)).cast("int") for k in range(FANOUT)]
        children = [F.xxhash64("path", F.lit(k), F.col("sketch")[at[k]]) for k in range(FANOUT)]
        level = (
            wide.join(sets.select("key", "sketch"), "key")
            .select("key", F.col("n").alias("above"), F.explode(F.array(*children)).alias("path"))
            .select("path", "key", "above")
        )


def _comparisons(leaves: DataFrame) -> DataFrame:
    """Rows of a leaf for each comparison they take part in: (i, j) compares
    block i of a leaf with block j; leaves up to BLOCK have one."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key", F.lit(11)), blocks).cast("int")
    return (
        leaves.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key")
    )


def _by_comparison(df: DataFrame) -> DataFrame:
    return df.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "key")


def _grouped(batches, columns):
    """The rows of one comparison after another, as a dict of lists."""
    names = ["leaf", "i", "j", *columns]
    held, at = {c: [] for c in names}, None
    for batch in batches:
        values = {c: batch.column(c).to_pylist() for c in ("leaf", "i", "j")}
        rest = {c: batch.column(c) for c in columns}
        where = list(zip(values["leaf"], values["i"], values["j"]))
        start = 0
        for k in range(1, len(where) + 1):
            if k == len(where) or where[k] != where[start]:
                if where[start] != at:
                    if at is not None:
                        yield at, held
                    at, held = where[start], {c: [] for c in names}
                for c in columns:
                    held[c].extend(rest[c].slice(start, k - start).to_pylist())
                start = k
    if at is not None:
        yield at, held


def _alike(least, batches):
    """The sets of each comparison that agree with another on enough coordinates
    (their lowest bytes: others agree by chance once in 256 times) and have a
    size that allows the similarity."""
    release()
    for (leaf, i, j), g in _grouped(batches, ["own", "key", "n", "low"]):
        s = np.frombuffer(b"".join(g["low"]), np.uint8).reshape(-1, COORDINATES)
        n = np.array(g["n"], np.int64)
        own = np.array(g["own"])
        hit = np.zeros(len(n), bool)
        order = np.argsort(n, kind="stable")
        s, n, own = s[order], n[order], own[order]
        upto = np.searchsorted(n, n / THRESHOLD + 1e-9, "right")
        for x in range(len(n) - 1):
            y = slice(x + 1, upto[x])
            if y.start >= y.stop:
                continue
            near = (s[y] == s[x]).sum(1) >= least
            if i != j:
                near &= own[y] != own[x]
            if near.any():
                hit[order[x]] = True
                hit[order[y][near]] = True
        keys = [k for k, h in zip(g["key"], hit) if h]
        if keys:
            m = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([leaf] * m, pa.int64()),
                    pa.array([i] * m, pa.int32()),
                    pa.array([j] * m, pa.int32()),
                    pa.array([o for o, h in zip(g["own"], hit) if h], pa.int32()),
                    pa.array(keys, pa.string()),
                ],
                names=["leaf", "i", "j", "own", "key"],
            )


def _grams(batches):
    release()
    for batch in batches:
        packed = [shingles(words_of(t.encode())).tobytes() for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["key", "grams"])


def links_of(grams: list[np.ndarray]):
    """For each set its links to later sets: (x, array of y). A pair counts if
    its Jaccard similarity is THRESHOLD or more; common n-grams are counted
    over the n-grams' lists of sets."""
    size = np.array([len(g) for g in grams])
    tokens, local = np.unique(np.concatenate(grams), return_inverse=True)
    owner = np.repeat(np.arange(len(grams)), size)
    by_token = np.argsort(local, kind="stable")
    posting = owner[by_token]
    start = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(tokens)))])
    first = np.concatenate([[0], np.cumsum(size)])
    for x in range(len(grams) - 1):
        mine = local[first[x] : first[x + 1]]
        mine = mine[start[mine + 1] - start[mine] > 1]
        if len(mine) == 0:
            continue
        common = np.bincount(np.concatenate([posting[start[t] : start[t + 1]] for t in mine.tolist()]), minlength=len(grams))
        y = x + 1 + np.flatnonzero(common[x + 1 :])
        c = common[y]
        y = y[c >= THRESHOLD * (size[x] + size[y] - c) - 1e-9]
        if len(y):
            yield x, y


def _verified(batches):
    """Exact links of each comparison: per set the number of documents it links
    to and the least key of those it hangs together with. A pair that meets in
    several leaves is counted in the least of them."""
    release()
    for (leaf, i, j), g in _grouped(batches, ["own", "key", "grams", "copies", "leaves"]):
        m = len(g["key"])
        own = np.array(g["own"])
        copies = np.array(g["copies"], np.int64)
        every = np.unique(np.concatenate([np.array(x, np.int64) for x in g["leaves"]]))
        member = np.zeros((m, len(every)), bool)
        for x, paths in enumerate(g["leaves"]):
            member[x, np.searchsorted(every, paths)] = True
        here = int(np.searchsorted(every, leaf))
        links = np.zeros(m, np.int64)
        top = list(range(m))

        def root(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for x, y in links_of([np.frombuffer(b, np.uint64) for b in g["grams"]]):
            if i != j:
                y = y[own[y] != own[x]]
            for k in y.tolist():
                a, b = root(x), root(k)
                if a != b:
                    top[max(a, b)] = min(a, b)  # rows come in the keys' order
            y = y[(member[y] & member[x]).argmax(1) == here]
            links[x] += copies[y].sum()
            links[y] += copies[x]
        roots = [root(x) for x in range(m)]
        rows = [x for x in range(m) if links[x] or roots[x] != x]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g["key"][x] for x in rows], pa.string()),
                    pa.array(links[rows]),
                    pa.array([g["key"][roots[x]] for x in rows], pa.string()),
                ],
                names=["key", "links", "least"],
            )


def components(edges: DataFrame) -> DataFrame:
    """(key, component): the least key that each key of ``edges`` (key, least)
    hangs together with. Every round takes the neighbours' least label, then the
    label's label, until nothing changes."""
    pairs = edges.where("key <> least").select("key", "least").distinct()
    both = cut(pairs.unionByName(pairs.select(F.col("least").alias("key"), F.col("key").alias("least"))))
    labels = cut(both.groupBy("key").agg(F.least(F.min("key"), F.min("least")).alias("component")))
    while True:
        around = (
            both.join(labels.select(F.col("key").alias("least"), "component"), "least")
            .groupBy("key")
            .agg(F.min("component").alias("seen"))
        )
        near = labels.join(around, "key").select("key", F.least("component", "seen").alias("via"), F.col("component").alias("old"))
        up = labels.select(F.col("key").alias("via"), F.col("component").alias("higher"))
        new = cut(near.join(up, "via").select("key", F.least("via", "higher").alias("component"), "old"))
        if new.where("component <> old").isEmpty():
            return labels
        labels = new.select("key", "component")


def _join(docs: DataFrame, id_col: str, text_col: str, runs: int | None) -> DataFrame:
    """One row per row of ``docs``: _id, text_key, key (equal words), n (set
    size), copies, links (between keys, in documents), component."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("_id"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text"))
    rows = cut(source.mapInArrow(_sketches, f"_id {kind}, text_key string, key string, n long, sketch array<int>, low binary"))
    # equal words are one set: it is sketched, placed and compared once
    sets = cut(
        rows.where("key is not null")
        .groupBy("key")
        .agg(F.first("sketch").alias("sketch"), F.first("low").alias("low"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min("text_key").alias("text_key"))
    )
    leaves = cut(_leaves(sets, sets.count(), runs or runs_needed()))
    compared = _by_comparison(_comparisons(leaves).join(sets.select("key", "n", "low"), "key"))
    alike = cut(compared.mapInArrow(partial(_alike, _least()), "leaf long, i int, j int, own int, key string"))

    wanted = sets.join(alike.select("key").distinct(), "key", "left_semi").select("key", "text_key", "copies")
    wanted = cut(wanted)
    side = wanted.select("key", "text_key")
    if side.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        side = F.broadcast(side)
    texts = source.select("text_key", "text").join(side, "text_key").groupBy("key").agg(F.first("text").alias("text"))
    grams = texts.mapInArrow(_grams, "key string, grams binary")
    paths = leaves.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.collect_list("leaf").alias("leaves"))
    full = cut(wanted.select("key", "copies").join(grams, "key").join(paths, "key"))
    verified = cut(_by_comparison(alike.join(full, "key")).mapInArrow(_verified, "key string, links long, least string"))

    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    found = (
        sets.select("key", "copies")
        .join(links, "key", "left")
        .join(components(verified), "key", "left")
        .where("copies > 1 or links is not null or component is not null")
    )
    return rows.select("_id", "text_key", "key", "n").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``class_id`` (the least id of
    those it hangs together with by links), ``n_links`` (other rows whose sets
    of 5-word n-grams have a Jaccard similarity of 0.8 or more), ``n_copies``
    (of these, rows of equal words) and ``n_shingles``.

    Words are runs of letters, digits and bytes above 127, A-Z in lower case.
    Sets of equal words are compared once. Minhash coordinates stand for a set;
    every run of the chosen-path trees buckets the sets by a coordinate, splits
    large buckets further and compares small ones at once. As many runs are
    made as bring a pair at the threshold together with TARGET_RECALL. Sets
    that agree on enough coordinates are verified on their texts, and each link
    is counted in one leaf, so that no list of pairs is ever written.

    Near copies that are all alike stay in one leaf; it is compared in blocks of
    BLOCK sets, spread over tasks. No row, partner or candidate is capped.

    Texts without words (null, empty) have no links and are classes of their
    own; texts of one to four words have one n-gram; rows that repeat are each
    other's copies; null ids are kept and come first in a class. An empty table
    gives an empty result.
    """
    joined = _join(docs, id_col, text_col, runs)
    first = joined.where("key is not null").groupBy("component").agg(F.min("_id").alias("class_id"))
    several = joined.where("copies is not null").select("component").distinct()
    first = first.join(several, "component", "left_semi").withColumnRenamed("component", "c")
    out = joined.join(first, (F.col("component") == F.col("c")) & F.col("copies").isNotNull(), "left")
    n_copies = F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("class_id", "_id").alias("class_id"),
        (n_copies + F.coalesce("links", F.lit(0))).alias("n_links"),
        n_copies.alias("n_copies"),
        F.col("n").alias("n_shingles"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """``docs`` with one row of each class of ``similarity_join``: that of the
    least id, then the least text hash. Rows that are alike in both are one."""
    joined = _join(docs, id_col, text_col, runs).where("copies is not null")
    same = cut(joined.groupBy("component", "_id", "text_key").agg(F.count(F.lit(1)).alias("rows")))
    kept = same.groupBy("component").agg(F.min(F.struct("_id", "text_key")).alias("k"))
    marked = cut(
        same.join(kept, "component")
        .withColumn("stays", F.col("k._id").eqNullSafe(F.col("_id")) & (F.col("k.text_key") == F.col("text_key")))
        .where("not stays or rows > 1")
        .select("_id", "text_key", "stays")
    )
    few = marked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    side = F.broadcast(marked) if few else marked
    key = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_doc"), key.alias("_key"))
    out = rows.join(side, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("text_key")), "left")
    single = out.where("stays is null").select("_row.*")
    repeated = out.where("stays").dropDuplicates(["_id", "text_key"]).select("_row.*")
    return single.unionByName(repeated)
