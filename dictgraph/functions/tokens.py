"""Tokenizers as column expressions (they run inside whole-stage codegen)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def segment_tokens(value, delimiter: str = "_") -> Column:
    """Identifier segments: split on the delimiter, empty segments dropped.

    Returns ``array<struct<pos:int, token:string>>`` with positions counted
    over the kept segments so adjacent-segment phrases are well defined."""
    parts = F.split(_col(value), _quote(delimiter))
    kept = F.filter(parts, lambda t: t != "")
    return F.transform(kept, lambda t, i: F.struct(i.alias("pos"), t.alias("token")))


def word_tokens(value, fold: bool = False) -> Column:
    """English word tokens: lower-cased runs of letters or digits; with ``fold``
    without accents.

    Returns ``array<struct<pos:int, token:string>>``."""
    return F.transform(words(value, fold), lambda t, i: F.struct(i.alias("pos"), t.alias("token")))


def words(value, fold: bool = False) -> Column:
    """The words of ``word_tokens`` alone, as ``array<string>``."""
    text = F.lower(_col(value))
    if fold:
        text = fold_accents(text)
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)


def _accents() -> tuple[str, str]:
    """Letters that are one base character with marks, and these bases; then the
    marks themselves, which ``translate`` drops because no base is left for them.
    The table is Unicode's own canonical decomposition."""
    letters, bases = [], []
    for c in map(chr, range(0x80, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and all(map(unicodedata.combining, parts[1:])):
            letters.append(c)
            bases.append(parts[0])
    marks = [chr(c) for c in range(0x300, 0x370)]
    return "".join(letters + marks), "".join(bases)


def fold_accents(value) -> Column:
    """The text without accents: México is Mexico. Letters of their own, such as
    ß, ø and ł, stay."""
    letters, bases = _accents()
    text = _col(value)
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, letters, bases)).otherwise(text)


def adjacent_pairs(tokens, sep: str) -> Column:
    """``array<struct<pos, token>>`` of adjacent tokens at the place of the
    first, joined by ``sep``, which no token may hold."""
    t = _col(tokens)
    return F.zip_with(
        F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
        F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
        lambda a, b: F.struct(a["pos"].alias("pos"), F.concat_ws(sep, a["token"], b["token"]).alias("token")),
    )


def _quote(delimiter: str) -> str:
    special = set("\\^$.|?*+()[]{}")
    return "".join("\\" + ch if ch in special else ch for ch in delimiter)
