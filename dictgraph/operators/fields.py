"""O7 ``descriptor_fields``: ordered property list of object descriptors.

Per requested gid (aliases resolved first, as O1 does):

* no term -> ``not_found``; ``_data._object`` missing or falsy -> ``not_object``
  (JavaScript truthiness: missing, null, false, 0, "" are falsy, every object
  and array is truthy);
* ``body = _open`` when truthy, else ``_closed``; neither -> ok, no fields;
* each ``_required`` entry's ``_selection`` is flattened depth-first: arrays
  recurse, strings are fields (``required = true``), anything else is
  skipped, a non-array ``_selection`` is ignored; then ``_recommended``
  strings follow (``required = false``);
* first occurrence of a field wins across both lists;
* a truthy non-array ``_required`` / ``_recommended`` -> ``malformed``.

Nested arrays are flattened level by level with ``posexplode`` over
``array<variant>`` casts, carrying ``sort_path`` (section, entry, positions…);
Spark orders arrays lexicographically with the shorter prefix first, which
is exactly depth-first order. The loop runs until no array remains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dictgraph.functions.constants import MALFORMED, NOT_OBJECT, OK
from dictgraph.functions.variant import is_array, is_string, is_truthy
from dictgraph.operators.terms import resolve_keys
from dictgraph.plans.lineage import cut_lineage, cut_lineage_counted, cut_lineage_observed


def _vget(v, path: str):
    return F.try_variant_get(v, path, "variant")


def _items(df: DataFrame, array_col: str, keep) -> DataFrame:
    """Explode a variant array column into ``(…, pos, item)``."""
    return df.select(*keep, F.posexplode(F.try_variant_get(F.col(array_col), "$", "array<variant>")).alias("pos", "item"))


def descriptor_fields(requests: DataFrame, terms: DataFrame, edges: DataFrame, gid_col: str = "gid") -> DataFrame:
    """``(gid, status, ord, field_gid, required)``, one row per field of each
    distinct requested gid; a gid without fields gets one row with NULL
    ``ord``/``field_gid``/``required``."""
    gids = requests.select(F.col(gid_col).alias("gid")).filter(F.col("gid").isNotNull()).distinct()
    res = resolve_keys(gids, terms, edges, with_doc=True)
    obj = _vget("doc", "$._data._object")
    body = F.when(is_truthy(_vget("__obj", "$._open")), _vget("__obj", "$._open")).when(
        is_truthy(_vget("__obj", "$._closed")), _vget("__obj", "$._closed")
    )
    staged = res.select("gid", "status", obj.alias("__obj")).select("gid", "status", "__obj", body.alias("body"))
    req = _vget("body", "$._required")
    rec = _vget("body", "$._recommended")
    staged = staged.select(
        "gid",
        F.when(F.col("status") != OK, F.col("status"))
        .when(~is_truthy("__obj"), F.lit(NOT_OBJECT))
        .when((is_truthy(req) & ~is_array(req)) | (is_truthy(rec) & ~is_array(rec)), F.lit(MALFORMED))
        .otherwise(F.lit(OK))
        .alias("status"),
        req.alias("req"),
        rec.alias("rec"),
    )
    staged = cut_lineage(staged)
    ok = staged.filter(F.col("status") == OK)

    # Required: every entry's _selection, when it is an array.
    entries = _items(ok.filter(is_array(F.col("req"))), "req", ["gid"])
    sel = entries.select("gid", F.array(F.lit(0), "pos").alias("sort_path"), _vget("item", "$._selection").alias("v"))
    pending, n_pending = cut_lineage_counted(sel.filter(is_array(F.col("v"))))
    emitted = []
    while n_pending:
        kids = _items(pending, "v", ["gid", "sort_path"]).select(
            "gid", F.concat("sort_path", F.array("pos")).alias("sort_path"), F.col("item").alias("v")
        )
        kids = kids.withColumn("is_array", is_array(F.col("v")))
        kids, stats = cut_lineage_observed(
            kids.filter(F.col("is_array") | is_string(F.col("v"))),
            arrays=F.coalesce(F.sum(F.col("is_array").cast("long")), F.lit(0)),
        )
        emitted.append(
            kids.filter(~F.col("is_array")).select(
                "gid", "sort_path", F.try_variant_get("v", "$", "string").alias("field_gid"), F.lit(True).alias("required")
            )
        )
        pending, n_pending = kids.filter("is_array").drop("is_array"), stats["arrays"]

    recommended = _items(ok.filter(is_array(F.col("rec"))), "rec", ["gid"])
    emitted.append(
        recommended.filter(is_string(F.col("item"))).select(
            "gid",
            F.array(F.lit(1), "pos").alias("sort_path"),
            F.try_variant_get("item", "$", "string").alias("field_gid"),
            F.lit(False).alias("required"),
        )
    )
    fields = reduce(DataFrame.unionByName, emitted)
    first = fields.groupBy("gid", "field_gid").agg(F.min(F.struct("sort_path", "required")).alias("f"))
    ordered = first.select(
        "gid",
        F.row_number().over(Window.partitionBy("gid").orderBy("f.sort_path")).alias("ord"),
        "field_gid",
        F.col("f.required").alias("required"),
    )
    return staged.select("gid", "status").join(ordered, "gid", "left").select(
        "gid", "status", "ord", "field_gid", "required"
    )
