"""Handle and key column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dictgraph.functions.constants import TERMS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def handle(key, collection: str = TERMS) -> Column:
    """Document handle ``collection/key`` (NULL key gives NULL)."""
    return F.concat(F.lit(collection + "/"), _col(key))


def key_of(h, collection: str = TERMS) -> Column:
    """Key part of a handle of ``collection``: what follows its prefix (a key
    may hold ``/`` itself). Anything else is returned as it is."""
    h = _col(h)
    prefix = collection + "/"
    return F.when(h.startswith(prefix), F.substring(h, len(prefix) + 1, 1 << 30)).otherwise(h)


def strip_collection(value, collection: str) -> Column:
    """Accept either a bare key or a ``collection/key`` handle."""
    return F.regexp_replace(_col(value), "^" + collection + "/", "")


def blob_key(item, type_, kind, identifier) -> Column:
    """Content-derived blob key: lower-case hex MD5 of ``item/type/kind/identifier``.

    ``concat`` with literal separators keeps a NULL part NULL instead of
    silently skipping it (``concat_ws`` would)."""
    return F.md5(
        F.concat(_col(item), F.lit("/"), _col(type_), F.lit("/"), _col(kind), F.lit("/"), _col(identifier))
    )
