"""VARIANT helpers: presence (``HAS``), JS-style truthiness and kind tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_field(v, path: str) -> Column:
    """True when the key exists, even if its value is JSON null."""
    return F.try_variant_get(_col(v), path, "variant").isNotNull()


def is_array(v) -> Column:
    """A JSON array (missing: false). Casting to an array of variants takes the
    top level only; no schema of what is below is derived."""
    return F.try_variant_get(_col(v), "$", "array<variant>").isNotNull()


def is_object(v) -> Column:
    """A JSON object (missing: false); top level only, as ``is_array``."""
    return F.try_variant_get(_col(v), "$", "map<string,variant>").isNotNull()


def is_container(v) -> Column:
    return is_array(v) | is_object(v)


def _scalar_text(v) -> Column:
    """JSON text of a scalar; NULL for containers and missing values."""
    return F.when(~is_container(v), F.to_json(_col(v)))


def is_string(v) -> Column:
    return F.coalesce(_scalar_text(v).startswith('"'), F.lit(False))


def is_json_null(v) -> Column:
    return F.coalesce(_scalar_text(v) == "null", F.lit(False))


def is_truthy(v) -> Column:
    """JavaScript truthiness of a variant value: missing, null, false, 0, NaN
    and the empty string are falsy; every object and array is truthy."""
    v = _col(v)
    text = _scalar_text(v)
    num = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull(), F.lit(False))
        .when(is_container(v), F.lit(True))
        .when(text.isin("null", "false", '""'), F.lit(False))
        .when(text.startswith('"') | (text == "true"), F.lit(True))
        .otherwise(F.coalesce((num != 0) & ~F.isnan(num), F.lit(True)))
    )
