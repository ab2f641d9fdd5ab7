"""Derived graph relations shared by the operators.

* ``edges_by_root``  usable edges keyed by ``(root, near)`` for traversal
* ``membership_relation``  ``M(leaf, root)``: literal enum-of membership
* ``alias_map``  alias shell -> canonical key (one enum-of edge per shell)

All are single-pass DataFrame expressions: explode, filter, aggregate.
Arg-min choices use ``min(struct(...))`` group aggregates, which combine
map-side before the shuffle, so a hot key never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictgraph.functions.constants import BRIDGE_OF, ENUM_OF, INBOUND, OUTBOUND
from dictgraph.plans.lineage import cut_lineage
from dictgraph.plans.sizing import broadcast_if_bounded, is_bounded


def check_direction(direction: str | None) -> str:
    direction = direction or INBOUND
    if direction not in (INBOUND, OUTBOUND):
        raise ValueError(f"direction must be 'inbound' or 'outbound', got {direction!r}")
    return direction


def orient(direction: str) -> tuple[str, str]:
    """``(near, far)`` edge ends: walking inbound leaves a vertex over edges
    whose ``_to`` is the vertex and arrives at ``_from``."""
    return ("_to", "_from") if check_direction(direction) == INBOUND else ("_from", "_to")


def exploded_paths(edges: DataFrame) -> DataFrame:
    """One row per (edge, distinct root handle in ``_path``)."""
    return edges.select("*", F.explode(F.array_distinct("_path")).alias("root_h"))


def edges_by_root(
    edges: DataFrame,
    predicates,
    direction: str = INBOUND,
    roots: DataFrame | None = None,
) -> DataFrame:
    """``(root_h, near, far, predicate, ekey, is_bridge)`` for usable edges.

    ``predicates=None`` keeps every predicate (a published table serves any
    predicate set). ``roots`` (a DataFrame with ``root_h``) keeps only the
    graphs a job asks for; NULL ``_path`` or predicate never qualifies."""
    near, far = orient(direction)
    e = edges.filter(F.col("_path").isNotNull() & F.col("_predicate").isNotNull())
    if predicates is not None:
        e = e.filter(F.col("_predicate").isin(list(predicates)))
    e = exploded_paths(e.select("_key", "_from", "_to", "_predicate", "_path"))
    if roots is not None:
        # broadcast: dealt by their root, all edges of a graph would go to one task
        e = e.join(broadcast_if_bounded(roots.select("root_h").distinct()), "root_h", "left_semi")
    return e.select(
        "root_h",
        F.col(near).alias("near"),
        F.col(far).alias("far"),
        F.col("_predicate").alias("predicate"),
        F.col("_key").alias("ekey"),
        (F.col("_predicate") == BRIDGE_OF).alias("is_bridge"),
    ).filter(F.col("near").isNotNull() & F.col("far").isNotNull())


def membership_relation(
    edges: DataFrame,
    direction: str = INBOUND,
    root_filter: Column | None = None,
    roots: DataFrame | None = None,
) -> DataFrame:
    """Distinct ``(leaf, root_h)``: the leaf handle sits at the leaf end of
    at least one enum-of edge whose ``_path`` holds the root handle.

    ``root_filter`` (a predicate on ``root_h``) or ``roots`` (a small
    DataFrame with ``root_h``, joined by broadcast) restrict the relation to
    the graphs asked for *before* the de-duplication shuffle; ``roots``
    must be of checked, bounded size."""
    leaf_end = "_from" if check_direction(direction) == INBOUND else "_to"
    e = edges.filter((F.col("_predicate") == ENUM_OF) & F.col(leaf_end).isNotNull())
    m = e.select(F.col(leaf_end).alias("leaf"), F.explode(F.array_distinct("_path")).alias("root_h"))
    if root_filter is not None:
        m = m.filter(root_filter)
    if roots is not None:
        m = m.join(F.broadcast(roots.select("root_h").distinct()), "root_h", "left_semi")
    return m.filter(F.col("root_h").isNotNull()).distinct()


def alias_edges(edges: DataFrame) -> DataFrame:
    """``(shell_h, f, k)`` of the enum-of edges: the end an alias is, the end it
    stands for, the edge's key."""
    e = edges.filter(F.col("_predicate") == ENUM_OF)
    return e.select(F.col("_to").alias("shell_h"), F.col("_from").alias("f"), F.col("_key").alias("k"))


def alias_map_of(shells: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(shell_h, canonical_h)`` for ``shells`` (``shell_h``): the ``f`` end of
    the candidate (see ``alias_edges``) with the smallest ``(f, k)``. Unfiltered
    by graph; one hop."""
    e = candidates.join(shells, "shell_h", "left_semi")
    return e.groupBy("shell_h").agg(F.min(F.struct("f", "k")).getField("f").alias("canonical_h"))


def alias_map(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """``alias_map_of`` every alias shell of the dictionary."""
    shells = terms.filter("is_alias").select(F.concat(F.lit("terms/"), "_key").alias("shell_h"))
    # few as a rule: the edges, of which few lead to one, need not move
    return alias_map_of(broadcast_if_bounded(cut_lineage(shells.distinct())), alias_edges(edges))


def usable_from_published(published: DataFrame, predicates, direction: str, roots: DataFrame) -> DataFrame:
    """Usable edges read from a published ``edges_by_root`` table (built
    inbound: ``near = _to``, ``far = _from``). Outbound swaps the two ends at
    read time; only the asked-for predicates and roots are kept, the roots as
    an ``IN`` filter when the set is small. The table is bucketed and sorted by
    ``near``, which is what a loop's frontier prunes on."""
    from dictgraph.operators.search import restrict_to_tokens

    u = published
    if check_direction(direction) == OUTBOUND:
        u = u.select("root_h", F.col("far").alias("near"), F.col("near").alias("far"), "predicate", "ekey", "is_bridge")
    u = u.filter(F.col("predicate").isin(list(predicates)))
    u = restrict_to_tokens(u, roots.select("root_h"), column="root_h")
    return u.select("root_h", "near", "far", "predicate", "ekey", "is_bridge")


# A published table of more bytes is read per hop, for its frontier's vertices
# alone; a smaller one is read whole once, which costs less than a scan a hop.
LARGE_TABLE_BYTES = 256 << 20


def is_large(df: DataFrame) -> bool:
    """Whether a table's files exceed LARGE_TABLE_BYTES (unknown: no)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > LARGE_TABLE_BYTES
    except Exception:  # Spark Connect shows no plan
        return False


class PublishedEdges:
    """Edges of a loop, read per hop from a published table in the order of
    ``near``: a small frontier is an ``IN`` filter on it."""

    def __init__(self, published: DataFrame):
        self.published = published

    def step(self, frontier: DataFrame, small: bool) -> DataFrame:
        from dictgraph.operators.search import restrict_to_tokens

        fr, keys = frontier.withColumnRenamed("vertex", "near"), ["root_h", "near"]
        edges = restrict_to_tokens(self.published, fr.select("near"), column="near", semi_join=False)
        if small:
            return F.broadcast(fr).join(edges, keys)
        if edges is self.published:
            # only by broadcast: a semi-join that moves the edges would move them
            # once more than the join itself does
            near = fr.select("near").distinct()
            if is_bounded(near):
                edges = edges.join(F.broadcast(near), "near", "left_semi")
        return fr.join(edges, keys)

    def has_bridges(self) -> bool:
        """Read by the statistics of the table's row groups, where there are none."""
        return not self.published.filter("is_bridge").isEmpty()
