"""Periodic runs of words, found in a Re-Pair grammar of the text."""

from __future__ import annotations

from collections import defaultdict
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.llm.common import release, ship_package

MIN_EXPONENT = 4  # a run has this many times its period, at least
MIN_LENGTH = 6  # and this many words
CUTS = 24  # rounds that cut texts at rare pairs; what is left goes to the grammar as it is


def re_pair(words: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, list[int]]]]:
    """Grammar of a word sequence: the most frequent adjacent pair of symbols
    (ties: the one that came up first) becomes a new symbol until no pair
    occurs twice.

    Returns the last sequence as ``(start, end)`` of each symbol's words, and
    for each rule, in the order of their making, its expansion ``(start, end)``
    at its first place, the boundary between its two symbols there, and all
    places where the text derives it directly from a pair."""
    n = len(words)
    sym = list(words)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    size = [1] * n  # words of the symbol that starts here
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(n - 1):
        places[sym[i], sym[i + 1]].append(i)
    serial = {pair: s for s, pair in enumerate(places)}
    heap = [(-len(at), serial[pair], pair) for pair, at in places.items() if len(at) > 1]
    heapify(heap)
    fresh = max(words, default=0) + 1
    rules = []
    while heap:
        count, _, pair = heappop(heap)
        at = places.pop(pair, None)
        if at is None:
            continue
        a, b = pair
        keep, last = [], -1
        for i in sorted(set(at)):
            if sym[i] != a or i == last:  # gone since, or overlaps the one before
                continue
            j = after[i]
            if j < n and sym[j] == b:
                keep.append(i)
                last = j
        if len(keep) < 2:
            continue
        if len(keep) < -count:  # others may be more frequent now
            places[pair] = keep
            heappush(heap, (-len(keep), serial[pair], pair))
            continue
        first = keep[0]
        rules.append((first, after[after[first]], after[first], keep))
        for i in keep:
            j = after[i]
            sym[i], sym[j] = fresh, -1
            size[i] += size[j]
            k = after[i] = after[j]
            if k < n:
                before[k] = i
        touched = {}
        for i in keep:
            p, k = before[i], after[i]
            if p >= 0:
                places[sym[p], fresh].append(p)
                touched[sym[p], fresh] = True
            if k < n and sym[k] != fresh:
                places[fresh, sym[k]].append(i)
                touched[fresh, sym[k]] = True
        for other in touched:
            if len(places[other]) > 1:
                heappush(heap, (-len(places[other]), serial.setdefault(other, len(serial)), other))
        fresh += 1
    last = []
    i = 0
    while i < n:
        last.append((i, i + size[i]))
        i = after[i]
    return last, rules


class Crossing:
    """Runs that cross a boundary inside a stretch of the text."""

    def __init__(self, words: list[int], exponent: int, length: int):
        self.words, self.exponent, self.length = words, exponent, length
        self.raw = np.asarray(words, np.int64).tobytes()  # stretches compare as bytes
        n = len(words)
        self.earlier, self.later = [-1] * n, [n] * n  # the next equal word on either side
        seen: dict[int, int] = {}
        for i, w in enumerate(words):
            j = seen.get(w, -1)
            if j >= 0:
                self.earlier[i], self.later[j] = j, i
            seen[w] = i

    def _same(self, i: int, j: int, n: int) -> bool:
        return self.raw[8 * i : 8 * (i + n)] == self.raw[8 * j : 8 * (j + n)]

    def _whole(self, s: int, t: int, lo: int, hi: int, q: int) -> tuple[int, int]:
        """The stretch of period ``q`` inside ``[s, t)`` around ``[lo, hi)``."""
        words = self.words
        while lo > s and words[lo - 1] == words[lo - 1 + q]:
            lo -= 1
        while hi < t and words[hi] == words[hi - q]:
            hi += 1
        return lo, hi

    def at(self, s: int, t: int, b: int) -> set[tuple[int, int, int]]:
        """``(start, end, period)`` of the runs inside ``[s, t)`` that have words
        on both sides of ``b``, each as far as it reaches there.

        With an exponent of 4 or more, one side of the boundary holds two whole
        periods. So a period is a distance from the last word before it to an
        equal one, or from the first word behind it. Longer distances inside a
        stretch of a period already found repeat that period and are passed over.
        """
        found = set()
        most = (t - s) // self.exponent
        i, covered = self.earlier[b - 1], 0
        while i >= 0 and b - 1 - i <= min(most, (b - s) // 2):
            q = b - 1 - i
            if 2 * q > covered and self._same(b - 2 * q, b - q, q):
                lo, hi = self._whole(s, t, b - 2 * q, b, q)
                covered = b - lo
                if hi > b and hi - lo >= max(self.length, self.exponent * q):
                    found.add((lo, hi, q))
            i = self.earlier[i]
        i, covered = self.later[b], 0
        while i < t and i - b <= min(most, (t - b) // 2):
            q = i - b
            if 2 * q > covered and self._same(b, b + q, q):
                lo, hi = self._whole(s, t, b, b + 2 * q, q)
                covered = hi - b
                if lo < b and hi - lo >= max(self.length, self.exponent * q):
                    found.add((lo, hi, q))
            i = self.later[i]
        return found


def grammar_runs(words: list[int], exponent: int = MIN_EXPONENT, length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every maximal run of a word sequence.

    Each rule's boundary is looked at once, inside the rule's expansion; what
    is found holds at every place where the text derives the rule. The symbols
    that no rule joins are joined by a balanced tree. A run lies whole in some
    expansion and crosses its boundary; pieces of it that deeper rules gave
    overlap it in a period or more and are merged into it."""
    last, rules = re_pair(words)
    crossing = Crossing(words, exponent, length)
    pieces: set[tuple[int, int, int]] = set()  # (period, start, end)
    for s, t, b, places in rules:
        if t - s < length:
            continue
        for lo, hi, q in crossing.at(s, t, b):
            # every place of the rule: where its pair was joined; a joined pair
            # stays inside whatever later rule takes it in
            for p in places:
                pieces.add((q, lo - s + p, hi - s + p))
    todo = [(0, len(last))]
    while todo:
        x, y = todo.pop()
        if y - x < 2:
            continue
        mid = (x + y) // 2
        s, t, b = last[x][0], last[y - 1][1], last[mid][0]
        if t - s >= length:
            pieces.update((q, lo, hi) for lo, hi, q in crossing.at(s, t, b))
            todo += [(x, mid), (mid, y)]
    return merged(pieces)


def merged(pieces) -> list[tuple[int, int, int]]:
    """Maximal runs ``(start, length, period)`` of pieces ``(period, start,
    end)``: pieces of one period that share a period of words are one run."""
    out: list[list[int]] = []
    for q, lo, hi in sorted(pieces):
        if out and out[-1][0] == q and out[-1][2] - lo >= q:
            out[-1][2] = max(out[-1][2], hi)
        else:
            out.append([q, lo, hi])
    return sorted((lo, hi - lo, q) for q, lo, hi in out)


def repeated_stretches(words: np.ndarray, text: np.ndarray, exponent: int = MIN_EXPONENT, length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """``(start, end)`` of the stretches that can hold runs.

    ``words`` are the word ids of many texts on end, ``text`` the number of each
    word's text. A run holds each of its adjacent pairs at least exponent - 1
    times, so none crosses a pair that its stretch holds less often; texts are
    cut at such pairs, and what remains again, until nothing more is cut."""
    if len(words) < 2:
        return []
    pair = words[:-1] * (int(words.max()) + 1) + words[1:]
    at = np.flatnonzero(text[:-1] == text[1:])
    kinds = np.unique(pair[at], return_inverse=True)[1]
    piece = text[at].astype(np.int64)
    for _ in range(CUTS):
        if not len(at):
            return []
        _, which, count = np.unique(piece * (int(kinds.max()) + 1) + kinds, return_inverse=True, return_counts=True)
        keep = count[which] >= exponent - 1
        opens = np.ones(len(at), bool)  # a stretch opens where the pair before is another stretch's or was cut
        opens[1:] = (np.diff(at) != 1) | (piece[1:] != piece[:-1]) | ~keep[:-1]
        at, kinds, opens, whole = at[keep], kinds[keep], opens[keep], bool(keep.all())
        if not len(at):
            return []
        piece = np.cumsum(opens) - 1
        long_enough = (np.bincount(piece) >= length - 1)[piece]
        whole = whole and bool(long_enough.all())
        at, kinds = at[long_enough], kinds[long_enough]
        piece = piece[long_enough]
        if whole:
            break
    if not len(at):
        return []
    first = np.flatnonzero(np.diff(piece, prepend=-1))
    final = np.append(first[1:], len(at)) - 1
    return list(zip(at[first].tolist(), (at[final] + 2).tolist()))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, size, q in runs:
        drop[start + q] += 1
        drop[start + size] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs(exponent: int, length: int, batches):
    release()
    for batch in batches:
        texts = [b"" if t is None else t for t in batch.column(1).cast(pa.binary()).to_pylist()]
        split = [t.split() for t in texts]  # of bytes: splits on ASCII white space alone
        del texts
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids = np.fromiter((number[w] for words in split for w in words), np.int64)
        sizes = np.array([len(words) for words in split], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
        for s, t in repeated_stretches(ids, np.repeat(np.arange(len(split)), sizes), exponent, length):
            row = int(np.searchsorted(begins, s, side="right")) - 1
            at = s - int(begins[row])
            runs[row] += [(at + a, n, q) for a, n, q in grammar_runs(ids[s:t].tolist(), exponent, length)]
        collapsed = [b" ".join(kept_words(words, sorted(r))) for words, r in zip(split, runs)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array([[{"start": a, "length": n, "period": q} for a, n, q in sorted(r, key=lambda x: (x[0], x[2]))] for r in runs], pa.list_(_RUN)),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            names=[batch.schema.field(0).name, "n_words", "runs", "collapsed"],
        )


def periodic_runs(
    docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` and ``collapsed`` of every row's whole text.

    Words are what ASCII white space parts. ``runs`` holds the ``start`` (word
    number from 0), ``length`` and smallest ``period`` of every stretch of at
    least ``min_length`` words and ``min_exponent`` periods that no neighbouring
    word extends, by start, then period. ``collapsed`` is the text without the
    words that a run holds after its first period, joined by single spaces.

    Each text is cut where no run can be, its stretches are compressed by
    Re-Pair, and runs are looked for once at each rule's boundary. The work of a
    row depends on that row alone: no shuffle; a very long text is held whole by
    its task (about 100 bytes a word of its stretches).

    A null or blank text has no words and no runs, its ``collapsed`` is empty;
    repeated rows and null ids are kept, one result each; overlapping runs are
    all listed, a word goes if any of them drops it; an empty table gives an
    empty result. Other columns take no part.
    """
    if min_exponent < 4 or min_length < 2:
        raise ValueError("runs of fewer than four periods or two words are not found by this method")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = (
        f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, "
        "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )
    return rows.mapInArrow(partial(_runs, min_exponent, min_length), schema)
