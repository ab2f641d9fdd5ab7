"""O4 ``check_membership``, O4b ``membership_pairs``, O4c ``validate_column``
and O6 ``resolve_then_check``.

Membership is literal: a term is accepted by a root iff at least one enum-of
edge has the term on its leaf end (``_from`` inbound, ``_to`` outbound) and
the root handle in ``_path``. No alias resolution, no traversal, and the term
need not have a document.

Plans are equi-joins against the membership relation ``M(leaf, root)``;
terms x roots is never formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.functions.constants import INBOUND
from dictgraph.functions.keys import handle
from dictgraph.operators._util import as_col
from dictgraph.plans.graph import check_direction, membership_relation
from dictgraph.plans.lineage import cut_lineage, cut_lineage_counted
from dictgraph.plans.sizing import DEFAULT_MAX_BROADCAST_ROWS, broadcast_if_bounded, broadcast_small

VALIDATE_MODES = ("flag", "valid", "invalid")


def _require_rows(df: DataFrame, what: str) -> None:
    if not df.isStreaming and df.limit(1).count() == 0:
        raise ValueError(f"{what} must hold at least one row")


def membership_pairs(
    terms: DataFrame,
    roots: DataFrame,
    edges: DataFrame | None,
    direction: str = INBOUND,
    gid_col: str = "gid",
    membership: DataFrame | None = None,
) -> DataFrame:
    """Distinct accepted ``(term, root)`` pairs of two request lists.
    ``membership`` is a published ``(leaf, root_h)`` table (O15, inbound) to
    read instead of ``edges``."""
    direction = check_direction(direction)
    root_keys = roots.select(F.col(gid_col).alias("root")).filter(F.col("root").isNotNull()).distinct()
    root_keys, n_roots = cut_lineage_counted(root_keys.select("root", handle("root").alias("root_h")))
    if membership is not None:
        _inbound(direction)
        m = membership.join(broadcast_small(root_keys, n_roots), "root_h")
    elif n_roots <= DEFAULT_MAX_BROADCAST_ROWS:
        m = membership_relation(edges, direction, roots=root_keys).join(F.broadcast(root_keys), "root_h")
    else:
        m = membership_relation(edges, direction).join(root_keys, "root_h")
    # Members of the asked-for roots, counted at their checkpoint: within
    # bound they are broadcast and the (possibly large) term list is joined
    # map-side.
    m, n_members = cut_lineage_counted(m)
    if n_members <= DEFAULT_MAX_BROADCAST_ROWS:
        m = F.broadcast(m)
    term_keys = terms.select(F.col(gid_col).alias("term")).filter(F.col("term").isNotNull()).distinct()
    return term_keys.join(m, handle("term") == m.leaf).select("term", "root")


def _inbound(direction: str) -> None:
    if direction != INBOUND:
        raise ValueError("a published membership table is inbound; pass edges for outbound")


def check_membership(
    terms: DataFrame,
    roots: DataFrame,
    edges: DataFrame | None,
    direction: str = INBOUND,
    gid_col: str = "gid",
    pos_col: str = "pos",
    repeat_duplicates: bool = False,
    membership: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct input term: ``(gid, pos, occurrences, roots)``.

    ``roots`` lists the accepting roots in root-list order (a root listed
    twice appears twice); ``[]`` when none accepts; ``pos`` is the first
    occurrence. The collected group per term is bounded by the root list.
    The original service repeated the list once per occurrence of a term in
    the input; ``occurrences`` carries that multiplicity, and
    ``repeat_duplicates=True`` materialises the repeated list (its length
    grows with the duplicates, so it is opt-in)."""
    direction = check_direction(direction)
    _require_rows(terms, "terms")
    _require_rows(roots, "roots")
    dterms = cut_lineage(
        terms.groupBy(F.col(gid_col).alias("gid")).agg(F.min(pos_col).alias("pos"), F.count(F.lit(1)).alias("occurrences"))
    )
    pairs = membership_pairs(dterms, roots.withColumnRenamed(gid_col, "gid"), edges, direction, "gid", membership)
    root_occ = broadcast_if_bounded(roots.select(F.col(gid_col).alias("root"), F.col(pos_col).alias("rpos")))
    accepted = (
        pairs.join(root_occ, "root")
        .groupBy(F.col("term").alias("gid"))
        .agg(F.array_sort(F.collect_list(F.struct("rpos", "root"))).alias("acc"))
    )
    out = dterms.join(accepted, "gid", "left")
    listed = F.coalesce(F.transform("acc", lambda s: s["root"]), F.array().cast("array<string>"))
    if repeat_duplicates:
        listed = F.flatten(F.array_repeat(listed, F.col("occurrences").cast("int")))
    return out.select("gid", "pos", "occurrences", listed.alias("roots"))


def validate_column(
    fact: DataFrame,
    code,
    root: str,
    edges: DataFrame | None,
    mode: str = "flag",
    direction: str = INBOUND,
    flag_col: str = "is_valid",
    max_broadcast_rows: int | None = None,
    membership: DataFrame | None = None,
) -> DataFrame:
    """Flag, keep or reject rows of a large (batch or streaming) fact table by
    literal membership of ``code`` (a gid expression) in ``root``.

    The members of one root are a narrow key set; it is broadcast when its
    size is within bound, so the fact side is scanned once and never
    shuffled. A NULL code is invalid. ``membership`` is a published ``(leaf,
    root_h)`` table (O15, inbound) to read instead of ``edges``. On a stream the
    members are part of each micro-batch's plan and are not frozen when the
    query is defined."""
    if mode not in VALIDATE_MODES:
        raise ValueError(f"mode must be one of {VALIDATE_MODES}, got {mode!r}")
    root_h = "terms/" + root
    if membership is not None:
        _inbound(direction)
        members = membership.filter(F.col("root_h") == F.lit(root_h))
    else:
        members = membership_relation(edges, direction, F.col("root_h") == F.lit(root_h))
    members = members.select(F.col("leaf").alias("__member")).distinct()
    limit = DEFAULT_MAX_BROADCAST_ROWS if max_broadcast_rows is None else max_broadcast_rows
    key = handle(as_col(code))
    if limit > 0 and not members.isStreaming and not fact.isStreaming:
        members, n_members = cut_lineage_counted(members)
        if n_members <= limit:
            members = F.broadcast(members)
        else:
            return _validate_by_codes(fact, key, members, mode, flag_col, limit)
    if mode == "valid":
        return fact.join(members, key == members["__member"], "left_semi")
    if mode == "invalid":
        return fact.join(members, key == members["__member"], "left_anti")
    return (
        fact.join(members, key == members["__member"], "left")
        .withColumn(flag_col, F.col("__member").isNotNull())
        .drop("__member")
    )


def _validate_by_codes(fact: DataFrame, key, members: DataFrame, mode: str, flag_col: str, limit: int) -> DataFrame:
    """Large member set: decide once per distinct code, then attach.

    Distinct codes are aggregated map-side first, so a code holding a third
    of the fact rows collapses to one row before any shuffle; only the
    per-code flags (broadcast when within bound) meet the fact table."""
    codes = fact.select(key.alias("__code")).filter(F.col("__code").isNotNull()).distinct()
    flags = codes.join(members, codes["__code"] == members["__member"], "left").select(
        "__code", F.col("__member").isNotNull().alias("__ok")
    )
    flags, n_flags = cut_lineage_counted(flags)
    if n_flags <= limit:
        flags = F.broadcast(flags)
    joined = fact.join(flags, key == flags["__code"], "left")
    ok = F.coalesce(F.col("__ok"), F.lit(False))
    if mode == "valid":
        return joined.filter(ok).drop("__code", "__ok")
    if mode == "invalid":
        return joined.filter(~ok).drop("__code", "__ok")
    return joined.withColumn(flag_col, ok).drop("__code", "__ok")


def resolve_then_check(
    fact: DataFrame,
    code,
    root: str,
    terms: DataFrame,
    edges: DataFrame,
    direction: str = INBOUND,
    resolved_col: str = "resolved_gid",
    flag_col: str = "is_valid",
    **resolve_kwargs,
) -> DataFrame:
    """Canonicalise ``code`` inside ``root`` (graph-aware resolution), then
    check literal membership of the canonical in the same root.

    Resolution runs once per distinct code; the answers join back to the
    fact table by broadcast when bounded."""
    from dictgraph.operators.resolve import resolve_in_graph

    codes = fact.select(as_col(code).alias("target")).filter(F.col("target").isNotNull()).distinct()
    reqs = codes.select(F.col("target").alias("request_id"), F.lit(root).alias("root"), "target")
    res = resolve_in_graph(reqs, edges, terms, direction=direction, with_doc=False, **resolve_kwargs)
    answers = res.select(F.col("target").alias("__code"), F.col("resolved_gid").alias(resolved_col))
    checked = validate_column(answers, resolved_col, root, edges, "flag", direction, flag_col)
    checked, n_checked = cut_lineage_counted(checked)
    checked = broadcast_small(checked, n_checked)
    out = fact.join(checked, as_col(code) == checked["__code"], "left").drop("__code")
    return out.withColumn(flag_col, F.coalesce(F.col(flag_col), F.lit(False)))
