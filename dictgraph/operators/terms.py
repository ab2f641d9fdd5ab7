"""O1 ``resolve_alias`` and O2 ``lookup_terms``.

A term that is an alias shell (no ``_info``, no ``_data``) is replaced by the
``_from`` end of one enum-of edge whose ``_to`` is the shell: one hop, not
filtered by graph, the canonical is not resolved again. Missing term, shell
without an edge, or a canonical without a document give ``not_found``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.functions.constants import NOT_FOUND, OK
from dictgraph.functions.keys import handle
from dictgraph.operators._util import join_back
from dictgraph.operators.search import MAX_PUSHED_TOKENS, restrict_to_tokens
from dictgraph.plans.graph import alias_edges, alias_map_of
from dictgraph.plans.lineage import cut_lineage, cut_lineage_counted, cut_lineage_observed
from dictgraph.plans.sizing import broadcast_small
from dictgraph.sources.dictionary import prepare_terms


def resolve_keys(
    gids: DataFrame, terms: DataFrame, edges: DataFrame | None, with_doc: bool = True, alias_table: DataFrame | None = None
) -> DataFrame:
    """``(gid, resolved_gid, status[, doc])`` for a DataFrame of distinct ``gid``.

    The dictionary is read for the requested keys only: a small set is pushed
    into its scans as an ``IN`` filter, a bounded one is a broadcast semi-join,
    a larger one a shuffle join of the narrow columns. Documents are read last,
    for the resolved keys. ``alias_table`` is a published ``(shell_h,
    canonical_h)`` table (O15) to read instead of ``edges``."""
    t = prepare_terms(terms)
    gids, n = cut_lineage_counted(gids.select("gid"))

    def of(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
        """Rows of the dictionary side ``df`` whose ``column`` is in ``keys``."""
        if n <= MAX_PUSHED_TOKENS:
            return restrict_to_tokens(df, keys, column)
        return df.join(broadcast_small(keys.select(column).distinct(), n), column, "left_semi")

    present = of(t.select(F.col("_key").alias("gid"), "is_alias"), gids, "gid")
    step, shells = cut_lineage_observed(
        gids.join(present, "gid", "left").withColumn("shell_h", F.when(F.col("is_alias"), handle("gid"))),
        n=F.count(F.when(F.col("is_alias"), 1)),
    )
    if shells["n"]:
        asked = step.filter("is_alias").select("shell_h")
        if alias_table is not None:
            amap = of(alias_table.select("shell_h", "canonical_h"), asked, "shell_h")
        else:
            amap = alias_map_of(asked, of(alias_edges(edges), asked, "shell_h"))
        step = step.join(amap, "shell_h", "left")
    else:
        step = step.withColumn("canonical_h", F.lit(None).cast("string"))
    canonical = F.when(F.col("canonical_h").startswith("terms/"), F.expr("substr(canonical_h, 7)"))
    step = cut_lineage(
        step.select(
            "gid",
            F.when(F.col("is_alias").isNull(), F.lit(None))
            .when(F.col("is_alias"), canonical)
            .otherwise(F.col("gid"))
            .alias("target"),
        )
    )
    payload = [F.col("_key").alias("target"), F.col("_key").alias("resolved_gid")]
    if with_doc:
        payload.append(F.col("doc"))
    targets = step.select("target").filter(F.col("target").isNotNull()).distinct()
    out = step.join(of(t.select(*payload), targets, "target"), "target", "left")
    cols = [
        "gid",
        "resolved_gid",
        F.when(F.col("resolved_gid").isNotNull(), F.lit(OK)).otherwise(F.lit(NOT_FOUND)).alias("status"),
    ]
    if with_doc:
        cols.append("doc")
    return out.select(*cols)


def resolve_alias(
    requests: DataFrame,
    terms: DataFrame,
    edges: DataFrame | None,
    gid_col: str = "gid",
    with_doc: bool = True,
    max_broadcast_rows: int | None = None,
    alias_table: DataFrame | None = None,
) -> DataFrame:
    """Requests plus ``resolved_gid``, ``status`` (and ``doc``). A published
    alias map (``alias_table``) is read instead of ``edges``.

    The lookup runs once per distinct gid; the answers are joined back, by
    broadcast when their count is within bound."""
    gids = requests.select(F.col(gid_col).alias("gid")).filter(F.col("gid").isNotNull()).distinct()
    answers = resolve_keys(gids, terms, edges, with_doc=with_doc, alias_table=alias_table)
    if gid_col != "gid":
        answers = answers.withColumnRenamed("gid", gid_col)
    out = join_back(requests, answers, gid_col, max_broadcast_rows, payload="doc" if with_doc else None)
    return out.withColumn("status", F.coalesce(F.col("status"), F.lit(NOT_FOUND)))


def lookup_terms(
    requests: DataFrame,
    terms: DataFrame,
    edges: DataFrame,
    gid_col: str = "gid",
    pos_col: str = "pos",
    with_doc: bool = True,
    ordered: bool = False,
) -> DataFrame:
    """O1 for a list: input order (``pos``) and duplicates kept, misses
    dropped. ``ordered=True`` sorts by ``pos`` (a global sort)."""
    out = resolve_alias(requests, terms, edges, gid_col=gid_col, with_doc=with_doc)
    out = out.filter(F.col("status") == OK).drop("status")
    return out.orderBy(pos_col) if ordered else out
