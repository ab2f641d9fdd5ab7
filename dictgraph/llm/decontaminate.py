"""Benchmark decontamination with a generalised suffix automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictgraph.llm.common import cut, held, place_of, ship_package, texts_of

WINDOW = 10
# Words of one automaton (a few hundred bytes each in a worker); a larger
# benchmark is cut into as many as it needs, and each makes its own pass.
BLOCK_WORDS = 250_000
CHUNK_WORDS = 5_000

_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
# lower-cases A-Z, keeps word bytes, blanks the rest; lengths stay as they are
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_NORMAL).split()


class Automaton:
    """Generalised suffix automaton over the words of ``items`` (pairs of an
    item's id and its words).

    State 0 is the root. ``length`` is the longest string of a state, ``link``
    its longest suffix in another state. A window (``window`` words, or a whole
    item of fewer) belongs to one state; ``items_at`` lists who has it.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.word_id: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            ids = [self.word_id.setdefault(w, len(self.word_id) + 1) for w in words]
            if ids:
                coded.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.items_at: dict[tuple[int, int], set[str]] = {}
        for name, ids in coded:
            size = min(window, len(ids))
            for state, matched, i in self.walk(ids):
                if i + 1 >= size:
                    at = self._suffix(state, size)
                    self.items_at.setdefault((at, size), set()).add(name)
        self.sizes = sorted({size for _, size in self.items_at})
        self.shortest = self.sizes[0] if self.sizes else 0
        # word pairs that some item has, as a bit table that may say yes too often
        bits = max(16, (4 * sum(len(ids) for _, ids in coded)).bit_length() + 2)
        self.mask = (1 << bits) - 1
        self.pairs = np.zeros(1 << bits, bool)
        for _, ids in coded:
            a = np.asarray(ids, np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True

    def _pair(self, a, b):
        return (a * 0x9E3779B1 + b * 0x85EBCA6B >> 7) & self.mask

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """Give the strings of q up to p's length plus one a state of their own."""
        clone = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def walk(self, ids):
        """State, longest matching length and place after each word."""
        step, link, length = self.step, self.link, self.length
        state = matched = 0
        for i, c in enumerate(ids):
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            nxt = step[state].get(c)
            if nxt is None:
                state = matched = 0
            else:
                state = nxt
                matched += 1
            yield state, matched, i

    def _suffix(self, state: int, size: int) -> int:
        """The state that has the last ``size`` words of ``state``'s strings."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def candidates(self, ids: np.ndarray):
        """Runs of word ids that may hold a window: enough known words in a row,
        each next pair known. Unknown words are 0."""
        known = ids > 0
        if self.shortest > 1:
            ok = known[:-1] & known[1:]
            ok[ok] = self.pairs[self._pair(ids[:-1][ok], ids[1:][ok])]
            extra = 1
        else:
            ok, extra = known, 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2] + extra
        wide = ends - starts >= self.shortest
        return zip(starts[wide].tolist(), ends[wide].tolist())

    def find(self, ids: np.ndarray, hit: np.ndarray):
        """Marks the words of all windows in ``hit``; yields the place after
        each window and the items that have it."""
        if not self.sizes:
            return
        for start, end in self.candidates(ids):
            for state, matched, i in self.walk(ids[start:end].tolist()):
                for size in self.sizes:
                    if size > matched:
                        break
                    items = self.items_at.get((self._suffix(state, size), size))
                    if items is not None:
                        at = start + i + 1
                        hit[at - size : at] = True
                        yield at, items


def match_batch(automaton: Automaton, texts: list[bytes]) -> list[tuple[np.ndarray, set[str]]]:
    """For every text its hit words (a mask) and the items whose windows it has."""
    get = automaton.word_id.get
    flat: list[int] = []
    starts = [0]
    for data in texts:
        flat.extend([get(w, 0) for w in words_of(data)])
        flat.append(0)  # no run crosses a text's end
        starts.append(len(flat))
    ids = np.asarray(flat, np.int64)
    hit = np.zeros(len(flat), bool)
    own: list[set[str]] = [set() for _ in texts]
    ends = np.asarray(starts[1:])
    for at, items in automaton.find(ids, hit):
        own[int(np.searchsorted(ends, at - 1, "right"))] |= items
    return [(hit[a : b - 1], s) for a, b, s in zip(starts, starts[1:], own)]


def automaton_of(block, window: int) -> Automaton:
    """The worker keeps the automaton it used last."""
    return held(("automaton", block.id, window), lambda: Automaton([(name, words.split()) for name, words in block.value], window))


def match(block, window: int, texts: list[bytes]):
    """For every text its hit words (a mask) and the items it has windows of;
    without a block nothing is hit."""
    if block is None:
        return [(np.zeros(len(words_of(t)), bool), set()) for t in texts]
    return match_batch(automaton_of(block, window), texts)


class _Block:
    """A broadcast of normalised items with a stable key for workers."""

    def __init__(self, broadcast, number: str):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


def _chunks(window, batches):
    for batch in batches:
        names, chunks, sizes = [], [], []
        for name, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            words = words_of(text.encode())
            for at in range(0, max(1, len(words) - window + 1), CHUNK_WORDS):
                part = words[at : at + CHUNK_WORDS + window - 1]
                if part:
                    names.append("" if name is None else name)
                    chunks.append(b" ".join(part))
                    sizes.append(len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(chunks, pa.binary()), pa.array(sizes, pa.int64())],
            names=["item", "words", "n"],
        )


def benchmark_blocks(
    benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, item_col: str = "item_id", text_col: str = "text"
) -> Iterator[tuple[int, _Block]]:
    """The number of blocks, and one after another as broadcasts, each of about
    ``block_words`` words of the benchmark, normalised. A block is taken back
    when the next is asked for, so that the driver and the workers hold one.
    Long items are cut into chunks that overlap by a window less one word, so
    that each window is whole in one of them."""
    spark = benchmark.sparkSession
    ship_package(spark)
    chunks = cut(
        benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(
            partial(_chunks, window), "item string, words binary, n long"
        )
    )
    total = chunks.agg(F.sum("n")).first()[0] or 0
    n = -(-total // block_words)
    block = F.pmod(F.xxhash64("item", "words"), F.lit(max(n, 1)))
    for k in range(n):
        rows = [(r.item, bytes(r.words)) for r in chunks.where(block == k).select("item", "words").distinct().collect()]  # about block_words words
        broadcast = spark.sparkContext.broadcast(rows)
        yield n, _Block(broadcast, f"{spark.sparkContext.applicationId}/{broadcast._jbroadcast.id()}")
        if n > 1:
            broadcast.unpersist()


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def cut_words(data: bytes, mask: np.ndarray) -> bytes:
    """The text without the marked words and what stands between them."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_NORMAL))]
    out, at = [], 0
    for a, b in spans(mask):
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]])


def _report(block, window, batches):
    for batch in batches:
        texts = [t.encode() for t in texts_of(batch.column(1))]
        yield _report_rows(batch, match(block, window, texts))


def _report_rows(batch, found):
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array([len(h) for h, _ in found], pa.int64()),
            pa.array([int(h.sum()) for h, _ in found], pa.int64()),
            pa.array([len(s) for _, s in found], pa.int64()),
            pa.array([sorted(s) for _, s in found], pa.list_(pa.string())),
            pa.array([max((b - a for a, b in spans(h)), default=0) for h, _ in found], pa.int64()),
        ],
        names=[batch.schema.field(0).name, "n_words", "n_hit", "n_items", "items", "longest_hit"],
    )


def _hits(block, window, batches):
    """Of the rows (``row``, text) that hit something: the hit spans, one start
    and end after another, and the items."""
    for batch in batches:
        found = match(block, window, [t.encode() for t in texts_of(batch.column(1))])
        hit = [(row, [x for span in spans(h) for x in span], sorted(s)) for row, (h, s) in zip(batch.column(0).to_pylist(), found) if s]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in hit], pa.int64()), pa.array([x[1] for x in hit], pa.list_(pa.int64())), pa.array([x[2] for x in hit], pa.list_(pa.string()))],
            names=["row", "spans", "items"],
        )


def _masks(batch, texts: list[bytes]):
    """Mask and items of each text from the columns ``spans`` and ``items``."""
    out = []
    for text, ends, items in zip(texts, batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
        mask = np.zeros(len(words_of(text)), bool)
        for a, b in zip((ends or [])[::2], (ends or [])[1::2]):
            mask[a:b] = True
        out.append((mask, set(items or [])))
    return out


def _report_merged(batches):
    for batch in batches:
        yield _report_rows(batch, _masks(batch, [t.encode() for t in texts_of(batch.column(1))]))


def _all_hits(rows: DataFrame, blocks, window: int) -> DataFrame:
    """``row``, ``spans`` and ``items`` over all blocks of the ``rows`` (``row``,
    ``text``) that are hit. Every block makes one pass, in which a task builds
    its automaton once; what it finds is written before the next block comes."""
    schema = "row long, spans array<bigint>, items array<string>"
    parts = [cut(rows.mapInArrow(partial(_hits, block, window), schema)) for _, block in blocks]
    merged = reduce(DataFrame.unionByName, parts).groupBy("row")  # a row for each block at most
    return merged.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Every row's ``id_col``, ``n_words``, ``n_hit`` (words inside a window
    that some benchmark item has too), ``n_items`` and ``items`` (ids of those
    items, as strings) and ``longest_hit`` (words of the longest hit span).

    Words are runs of digits, letters and bytes above 127, with A-Z in lower
    case. The words of each text stream through a generalised suffix automaton
    of all items; where the longest match reaches a window's length, its words
    are hit. Items of fewer words than a window count as one window.

    A null text or item has no words; a null item id reads as the empty string;
    items that repeat an id count once; repeated rows and null ids are kept,
    one result each; without items nothing is hit; an empty table gives an empty
    result. A very long text is held whole by its task. With a benchmark of one
    block documents are not shuffled; with more, every block passes over the
    documents and what they hit is merged by row.
    """
    blocks = lambda: benchmark_blocks(benchmark, window, block_words, item_col, item_text_col)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = (
        f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, n_hit long, n_items long, "
        "items array<string>, longest_hit long"
    )
    n, block = next(blocks(), (0, None))
    if n < 2:
        return rows.mapInArrow(partial(_report, block, window), schema)
    rows = cut(rows.select(F.col(id_col).alias("id"), "text", F.monotonically_increasing_id().alias("row")))
    merged = _all_hits(rows.select("row", "text"), blocks(), window)
    return rows.join(merged, "row", "left").select(F.col("id").alias(id_col), "text", "spans", "items").mapInArrow(_report_merged, schema)


def _clean(block, window, max_coverage, text_at, batches):
    for batch in batches:
        column = batch.column(text_at)
        texts = [t.encode() for t in texts_of(column)]
        keep, out = np.ones(len(texts), bool), list(texts)
        todo = list(range(len(texts)))
        first = True
        while todo:  # a cut brings words together, so what was cut is read again
            found = match(block, window, [out[i] for i in todo])
            again = []
            for i, (hit, _) in zip(todo, found):
                if hit.any():
                    if first and hit.mean() > max_coverage:
                        keep[i] = False
                    else:
                        out[i] = cut_words(out[i], hit)
                        again.append(i)
            todo, first = again, False
        valid = column.is_valid().to_pylist()
        new = pa.array([o.decode() if v else None for o, v in zip(out, valid)], pa.string())
        yield batch.set_column(text_at, batch.schema.field(text_at).name, new).filter(pa.array(keep))


def _cut_merged(max_coverage, batches):
    """``row``, the text without its hit spans, and whether the row stays."""
    for batch in batches:
        texts = [t.encode() for t in texts_of(batch.column(1))]
        masks = [m for m, _ in _masks(batch, texts)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([cut_words(t, m).decode() for t, m in zip(texts, masks)], pa.string()),
                pa.array([bool(m.mean() <= max_coverage) for m in masks]),
            ],
            names=["row", "text", "stays"],
        )


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.8,
    block_words: int = BLOCK_WORDS,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` with every hit span cut out of ``text_col`` (see
    ``find_contamination``); rows of which more than ``max_coverage`` of the
    words are hit go. What is left holds no window of any item. Other columns,
    null texts and clean rows stay as they are; repeated rows are treated alike,
    an empty table stays empty. A very long text is held whole by its task."""
    blocks = lambda: benchmark_blocks(benchmark, window, block_words, item_col, item_text_col)
    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    n, block = next(blocks(), (0, None))
    if n < 2:
        return rows.mapInArrow(partial(_clean, block, window, max_coverage, place_of(rows, text_col)), rows.schema)
    name = rows.columns[place_of(rows, text_col)]
    rows = cut(rows.select(F.struct(*rows.columns).alias("all"), F.monotonically_increasing_id().alias("row")))
    todo = rows.select("row", F.col(f"all.`{name}`").alias("text"))
    changes, share = [], max_coverage
    while True:  # a cut brings words together, so what was cut is read again
        hit = cut(_all_hits(todo, blocks(), window))
        if hit.isEmpty():
            break
        new = cut(todo.join(hit, "row").mapInArrow(partial(_cut_merged, share), "row long, text string, stays boolean"))
        changes.append(new.withColumn("turn", F.lit(len(changes))))
        todo, share = new.where("stays").select("row", "text"), 1.0
    if not changes:
        return rows.select("all.*")
    last = reduce(DataFrame.unionByName, changes).groupBy("row").agg(F.max_by(F.struct("text", "stays"), "turn").alias("new"))
    out = rows.join(last, "row", "left").where(F.coalesce("new.stays", F.lit(True)))
    text = F.when(F.col("new").isNotNull(), F.col("new.text")).otherwise(F.col(f"all.`{name}`"))
    return out.select(*[text.alias(c) if c == name else F.col(f"all.`{c}`").alias(c) for c in docs.columns])


def items_digest(items) -> Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)

