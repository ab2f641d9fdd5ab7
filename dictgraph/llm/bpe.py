"""Byte-level byte-pair merging over a public vocabulary file.

Inside the merge loop a symbol is a number: a byte is 0..255 and the result of
merge rule r is 256 + r, so that the smaller number is the earlier rule.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

from tokenizers.pre_tokenizers import ByteLevel

# The vocabulary's published split pattern with its classes
# written out for the code points up to U+024F and common punctuation. Which
# of the others are letters depends on the Unicode version, so texts with such
# code points are split by the library's own splitter.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
COMMON_PATTERN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
# Bytes of a word whose pairs are looked through rather than kept in a heap.
SHORT = 24
NO_RULE = 1 << 40
_SPLITTER = ByteLevel(add_prefix_space=False)
_UNCOMMON = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")


def split_words(text: str) -> list[str]:
    """Pieces that merging never crosses; joined they give the text again."""
    if text.isascii() or _UNCOMMON.search(text) is None:
        return COMMON_PATTERN.findall(text)
    return [text[a:b] for _, (a, b) in _SPLITTER.pre_tokenize_str(text)]


def byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary file: itself
    where printable, else the next unused one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge rules and ids of one vocabulary file (JSON of the tokenizers
    library: byte-level BPE without normalizer, added tokens without flags)."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        assert model["type"] == "BPE" and spec["normalizer"] is None and not spec["pre_tokenizer"]["add_prefix_space"]
        assert not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = (
            re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        names = byte_chars()
        number = {c: b for b, c in enumerate(names)}
        self.pairs: dict[int, int] = {}
        for rank, rule in enumerate(model["merges"]):
            a, b = rule if isinstance(rule, list) else rule.split(" ")
            self.pairs[number[a] << 20 | number[b]] = number[a + b] = 256 + rank
            names.append(a + b)
        self.ids = [model["vocab"][n] for n in names]
        back = {c: b for b, c in enumerate(byte_chars())}
        self.id_bytes = {i: bytes(back[c] for c in n) for n, i in model["vocab"].items()}
        self.id_bytes |= {i: n.encode() for n, i in self.special.items()}

    def sections(self, text: str) -> list[str]:
        """Ordinary text at even positions, added tokens at odd ones."""
        if self.special_split is None or not any(s in text for s in self.special):
            return [text]
        return self.special_split.split(text)

    def merge(self, word: bytes) -> tuple[list[int], int]:
        """Symbols after merging (-1: merged into the one before it) and the
        number of merges. Adjacent pairs wait in a heap; the lowest rule, then
        the leftmost place, goes first; a linked list joins the neighbours."""
        sym = list(word)
        n = len(sym)
        get = self.pairs.get
        heap = []
        for i in range(n - 1):
            m = get(sym[i] << 20 | sym[i + 1])
            if m is not None:
                heap.append(m << 40 | i)
        if not heap:
            return sym, 0
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        merges = 0
        while heap:
            top = heappop(heap)
            m, i = top >> 40, top & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or sym[i] < 0 or get(sym[i] << 20 | sym[j]) != m:
                continue
            sym[i], sym[j] = m, -1
            merges += 1
            k = after[i] = after[j]
            before[k] = i
            if k < n:
                q = get(m << 20 | sym[k])
                if q is not None:
                    heappush(heap, q << 40 | i)
            p = before[i]
            if p >= 0:
                q = get(sym[p] << 20 | m)
                if q is not None:
                    heappush(heap, q << 40 | p)
        return sym, merges

    def count(self, word: str) -> int:
        """Tokens of one piece: its bytes less its merges."""
        data = word.encode()
        return len(data) - self.merge(data)[1]

    def encode(self, word: str) -> list[int]:
        ids = self.ids
        data = word.encode()
        if len(data) > SHORT:
            return [ids[s] for s in self.merge(data)[0] if s >= 0]
        return [ids[s] for s in self.merge_short(data)]

    def merge_short(self, word: bytes) -> list[int]:
        """Symbols of a short word after merging: its few pairs are looked
        through for the lowest rule, then the leftmost place, each time."""
        sym = list(word)
        get = self.pairs.get
        rules = [get(a << 20 | b, NO_RULE) for a, b in zip(sym, sym[1:])]
        while rules:
            m = min(rules)
            if m == NO_RULE:
                break
            i = rules.index(m)
            sym[i] = m
            del sym[i + 1], rules[i]
            if i < len(rules):
                rules[i] = get(m << 20 | sym[i + 1], NO_RULE)
            if i:
                rules[i - 1] = get(sym[i - 1] << 20 | m, NO_RULE)
        return sym


class Memo(dict):
    """Results of a function of a word, of about ``size`` bytes at most; words
    longer than ``longest`` are worked out anew each time."""

    ENTRY = 180  # of a word and its place in the table, beside letters and result

    def __init__(self, fn, size: int = 32 << 20, longest: int = 64):
        super().__init__()
        self.fn, self.size, self.longest, self.used = fn, size, longest, 0

    def __missing__(self, word):
        value = self.fn(word)
        if word is None or len(word) <= self.longest:
            cost = self.ENTRY + (len(word) if word else 0) + (len(value) if isinstance(value, bytes) else 0)
            if self.used + cost > self.size:
                self.clear()
                self.used = 0
            self.used += cost
            self[word] = value
        return value
