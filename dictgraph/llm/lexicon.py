"""Minimal acyclic transducer from words to token ids.

Words are byte strings. The automaton shares prefixes and suffixes; every arc
carries the number of words that sort before it from its state, so the sum
along a path numbers the words in order, and that number selects the ids.
"""

from __future__ import annotations

import mmap

import numpy as np

MAGIC = b"LEXIDS01"


def build(entries: dict[bytes, list[int]]) -> bytes:
    """Automaton and outputs as one block that can be memory-mapped.

    States are registered from the leaves up while words arrive in order; a
    state whose finality and arcs equal a registered one is replaced by it.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # registered: final, ((label, target), ...)
    path: list[list] = [[False, []]]  # unregistered states of the last word

    def settle(depth: int) -> None:
        while len(path) > depth:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            if path:
                label = path[-1][1].pop()
                path[-1][1].append((label, register[key]))

    last = b""
    for word in words:
        shared = 0
        while shared < len(word) and shared < len(last) and word[shared] == last[shared]:
            shared += 1
        settle(shared + 1)
        for label in word[shared:]:
            path[-1][1].append(label)
            path.append([False, []])
        path[-1][0] = True
        last = word
    settle(0)

    # targets are registered before their sources, so one pass counts words
    words_from = np.zeros(len(states), np.int64)
    first, labels, targets, skips = [0], bytearray(), [], []
    for s, (final, arcs) in enumerate(states):
        seen = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(seen)
            seen += int(words_from[target])
        words_from[s] = seen
        first.append(len(labels))
    outputs = [np.asarray(entries[w], np.uint32) for w in words]
    ends = np.cumsum([len(o) for o in outputs], dtype=np.int64)
    blocks = [
        np.asarray([final for final, _ in states], np.uint8).tobytes(),
        np.asarray(first, np.int64).tobytes(),
        bytes(labels),
        np.asarray(targets, np.int64).tobytes(),
        np.asarray(skips, np.int64).tobytes(),
        ends.tobytes(),
        (np.concatenate(outputs) if outputs else np.empty(0, np.uint32)).tobytes(),
    ]
    out = bytearray(MAGIC + np.asarray([len(b) for b in blocks], np.int64).tobytes())
    for b in blocks:
        out += b"\0" * (-len(out) % 8) + b
    return bytes(out)


class Lexicon:
    """A block made by ``build``, read in place from a memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        assert self.map[:8] == MAGIC
        sizes = np.frombuffer(self.map, np.int64, 7, 8)
        at, starts = 8 + 7 * 8, []
        for size in sizes:
            at += -at % 8
            starts.append(at)
            at += int(size)
        view = memoryview(self.map)

        def block(i: int, kind: str):
            return view[starts[i] : starts[i] + int(sizes[i])].cast(kind)

        self.final, self.first, self.target = block(0, "B"), block(1, "q"), block(3, "q")
        self.skip, self.end, self.output = block(4, "q"), block(5, "q"), block(6, "I")
        self.labels = starts[2]
        self.states = len(self.final)

    def number(self, word: bytes) -> int:
        """Place of the word in order, or -1 if it is not in the lexicon."""
        find, first, base = self.map.find, self.first, self.labels
        state, number = self.states - 1, 0
        for i in range(len(word)):
            at = find(word[i : i + 1], base + first[state], base + first[state + 1])
            if at < 0:
                return -1
            number += self.skip[at - base]
            state = self.target[at - base]
        return number if self.final[state] else -1

    def ids(self, word: bytes) -> list[int] | None:
        n = self.number(word)
        if n < 0:
            return None
        return self.output[self.end[n - 1] if n else 0 : self.end[n]].tolist()
