"""O3 ``expand_enum``: breadth-first expansion of enumeration hierarchies.

Per request ``(request_id, root, branch)``:

* usable edge: the root handle is in ``_path`` and the predicate is enum-of,
  section-of or bridge-of (filtered up front, so an unusable edge never marks
  a vertex as visited);
* inbound walks from a vertex over edges whose ``_to`` is the vertex (to
  ``_from``); outbound mirrors it;
* every vertex is visited once per request, the start vertex included; a
  vertex reached over a bridge is visited but not emitted;
* ``level = hops - bridges`` on the path; ``hops <= levels + 1`` and
  ``level <= levels`` are two independent bounds;
* ``parent`` is the handle of the nearest preceding vertex not entered over a
  bridge (carried as ``anchor``);
* several usable edges reaching one vertex at the same hop: non-bridge first,
  then smaller level, then smaller parent handle, then smaller edge key.

The loop runs all requests together (once per distinct (root, branch)). Pairs
have a long of their own; a hop joins the frontier with the usable edges where those lie, then one
aggregation per (pair, vertex) applies the tie-break as a ``min(struct)``
(combined map-side, so a hub vertex does not collect in one task), and rows of
vertices visited before are dropped by joins with the earlier hops' rows, which
lie bucketed on the same key and do not move. Each hop is written once into the
session's reliable checkpoint folder, its row count observed on the way; the
loop stops on an empty frontier or after ``levels + 1`` hops (``levels`` when the
graphs have no bridge edge, which then cannot change the result). Edges come
either from ``edges`` (filtered and bucketed once) or from a published
``edges_by_root`` table, which, where it is large, is read per hop with the
frontier pushed into the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.functions.constants import BRIDGE_OF, EMITTED_PREDICATES, EXPAND_PREDICATES, INBOUND
from dictgraph.functions.keys import handle, key_of
from dictgraph.plans.graph import PublishedEdges, check_direction, edges_by_root, is_large, usable_from_published
from dictgraph.plans.lineage import cut_lineage_counted
from dictgraph.plans.loopstate import HUB_EDGES, LoopEdges, LoopTables, Visited
from dictgraph.plans.sizing import DEFAULT_MAX_BROADCAST_ROWS, LOOP_MAX_BROADCAST_ROWS, broadcast_small
from dictgraph.sources.dictionary import prepare_terms

MAX_LEVELS = 20
SHAPES = ("full", "compact")


def check_levels(levels, upper: int, default: int) -> int:
    if levels is None:
        return default
    if isinstance(levels, bool) or int(levels) != levels:
        raise ValueError(f"levels must be an integer, got {levels!r}")
    levels = int(levels)
    if not 1 <= levels <= upper:
        raise ValueError(f"levels must be within 1..{upper}, got {levels}")
    return levels


def expand_enum(
    requests: DataFrame,
    edges: DataFrame,
    terms: DataFrame | None = None,
    levels: int = 1,
    direction: str = INBOUND,
    shape: str = "compact",
    max_broadcast_rows: int = LOOP_MAX_BROADCAST_ROWS,
    null_missing: bool = False,
    usable_edges: DataFrame | None = None,
    by_pair: bool = False,
    hub_edges: int = HUB_EDGES,
) -> DataFrame:
    """``(request_id, gid | term, predicate, level, parent, hops)``.

    With ``by_pair`` the rows carry ``root`` and ``branch`` instead of
    ``request_id``, once per distinct pair: where many requests share a large
    branch, its rows are not copied to each of them.

    ``requests`` holds ``request_id``, ``root`` and an optional ``branch``
    (NULL or absent means the root). ``shape='full'`` attaches the term
    document as ``term`` (NULL for an endpoint without a document) and needs
    ``terms``. By default ``gid`` and ``parent`` are the edge endpoints' key
    and handle whether or not a document exists; ``null_missing=True`` gives
    the document-based form instead (NULL ``gid``/``parent`` when the vertex
    or parent has no document; rows are kept) and needs ``terms``.
    ``usable_edges`` reads a published ``edges_by_root`` table (O15) instead
    of exploding ``edges`` again (``edges`` may then be None). The edges of a
    vertex with more than ``hub_edges`` are dealt over several buckets."""
    depth = check_levels(levels, MAX_LEVELS, 1)
    direction = check_direction(direction)
    if shape not in SHAPES:
        raise ValueError(f"shape must be one of {SHAPES}, got {shape!r}")
    if (shape == "full" or null_missing) and terms is None:
        raise ValueError("shape='full' and null_missing need the terms DataFrame")

    branch = F.coalesce(F.col("branch"), F.col("root")) if "branch" in requests.columns else F.col("root")
    keyed = requests.select(
        "request_id",
        handle("root").alias("root_h"),
        handle(branch).alias("vertex"),
    ).filter(F.col("root_h").isNotNull() & F.col("vertex").isNotNull())
    # The loop runs over distinct (root, branch) pairs, aggregated map-side so
    # that a popular branch is not walked once per request; request ids are
    # attached at the end, once per row of the requests.
    keyed, n_requests = cut_lineage_counted(keyed)
    pairs, n_pairs = cut_lineage_counted(
        keyed.select("root_h", "vertex").distinct().withColumn("pair", F.monotonically_increasing_id())
    )
    # Where each pair has one request and each request its own id, the loop runs
    # on the ids: its rows, which may be many times the requests, meet no join.
    own = not by_pair and n_pairs == n_requests and keyed.agg(F.countDistinct("request_id")).first()[0] == n_requests
    if own:
        pairs = keyed.select("root_h", "vertex", F.col("request_id").alias("pair"))
    tables = LoopTables(requests.sparkSession)
    try:
        out = _loop(tables, pairs, n_pairs, edges, usable_edges, depth, direction, max_broadcast_rows, hub_edges)
        names = pairs.select("pair", F.col("root_h").alias("__root"), F.col("vertex").alias("__branch"))
        if by_pair:
            out = out.join(broadcast_small(names, n_pairs), "pair")
            out = out.withColumns({"root": key_of("__root"), "branch": key_of("__branch")}).drop("pair", "__root", "__branch")
            keys = ["root", "branch"]
        elif own:
            out = out.withColumnRenamed("pair", "request_id")
            keys = ["request_id"]
        else:
            same = (F.col("root_h") == F.col("__root")) & (F.col("vertex") == F.col("__branch"))
            ids = keyed.join(broadcast_small(names, n_pairs), same).select("pair", F.col("request_id").alias("__rid"))
            ids = broadcast_small(ids, n_requests, DEFAULT_MAX_BROADCAST_ROWS)
            out = out.join(ids, "pair").drop("pair").withColumnRenamed("__rid", "request_id")
            keys = ["request_id"]
        out = out.select(*keys, "vertex", "predicate", "level", "parent", "hops")
    except BaseException:
        tables.close()
        raise
    tables.close(lasting=True)
    gid = key_of("vertex")
    parent = F.col("parent")
    if null_missing:
        have = prepare_terms(terms).select(handle("_key").alias("__h"))
        out = out.join(have.withColumnRenamed("__h", "vertex").withColumn("__v", F.lit(True)), "vertex", "left")
        out = out.join(have.withColumnRenamed("__h", "parent").withColumn("__p", F.lit(True)), "parent", "left")
        gid = F.when(F.col("__v"), gid)
        parent = F.when(F.col("__p"), parent)
    if shape == "compact":
        return out.select(*keys, gid.alias("gid"), "predicate", "level", parent.alias("parent"), "hops")
    docs = prepare_terms(terms).select(handle("_key").alias("vertex"), F.col("doc").alias("term"))
    return out.join(docs, "vertex", "left").select(
        *keys, gid.alias("gid"), "term", "predicate", "level", parent.alias("parent"), "hops"
    )


def _loop(tables, pairs, n_pairs, edges, published, depth, direction, max_broadcast_rows, hub_edges) -> DataFrame:
    """``(pair, vertex, predicate, level, parent, hops)`` of the distinct pairs."""
    max_hops = depth + 1
    start = pairs.select("pair", "root_h", "vertex")
    frontier_rows = n_pairs
    if published is not None and is_large(published):
        # the hops need little of it
        graph = PublishedEdges(usable_from_published(published, EXPAND_PREDICATES, direction, start.select("root_h")))
        bridged = graph.has_bridges()
    else:
        if published is not None:
            usable = usable_from_published(published, EXPAND_PREDICATES, direction, start.select("root_h"))
        else:
            usable = edges_by_root(edges, EXPAND_PREDICATES, direction, start.select("root_h"))
        bridges = F.coalesce(F.sum(F.col("is_bridge").cast("long")), F.lit(0))
        graph = LoopEdges(tables, usable, hub_edges, max(max_broadcast_rows, 0), rank=("ekey", "predicate"), bridges=bridges)
        bridged = graph.stats["bridges"] > 0
    # Without any bridge edge no path can gain the bridge budget's extra hop
    # (its rows would all have level > levels), so the loop stops a hop early.
    if not bridged:
        max_hops = depth
    keys = ["pair", "vertex"]
    # The anchor of a vertex is the vertex itself, or behind a bridge its parent:
    # it moves with no candidate. A vertex's root is its pair's and never ties.
    anchor = F.when(F.col("predicate") == BRIDGE_OF, F.col("parent")).otherwise(F.col("vertex"))
    frontier = start.withColumn("level", F.lit(0)).withColumn("anchor", F.col("vertex"))
    visited = Visited(tables, keys)
    visited.add(frontier, n_pairs)
    emitted = []
    for hop in range(1, max_hops + 1):
        last = hop == max_hops
        if last:
            # Nothing goes on from here, and a bridge or a level too deep never
            # wins over a row that is emitted: such candidates are not made.
            frontier = frontier.filter(F.col("level") < depth)
        step = graph.step(frontier, frontier_rows <= max_broadcast_rows).select(
            "pair",
            "root_h",
            F.col("far").alias("vertex"),
            "is_bridge",
            (F.col("level") + F.when(F.col("is_bridge"), 0).otherwise(1)).alias("level"),
            F.col("anchor").alias("parent"),
            "ekey",
            "predicate",
        )
        if last:
            step = step.filter(~F.col("is_bridge"))
        best = visited.aggregate(step, b=F.min(F.struct("is_bridge", "level", "parent", "ekey", "predicate", "root_h"))).filter(~F.col("seen"))
        new, stats = visited.keep(best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in ("root_h", "level", "parent", "predicate")]), lasting=True)
        frontier_rows = stats["rows"]
        if frontier_rows == 0:
            break
        emitted.append(
            new.filter(F.col("predicate").isin(list(EMITTED_PREDICATES)) & (F.col("level") <= depth)).select(
                *keys, "predicate", "level", "parent", F.lit(hop).alias("hops")
            )
        )
        frontier = new.select("pair", "root_h", "vertex", "level", anchor.alias("anchor"))
        if not last:
            visited.add(new, frontier_rows)
    if not emitted:
        nothing = F.lit(None).cast("string")
        return start.limit(0).select(*keys, nothing.alias("predicate"), F.lit(0).alias("level"), nothing.alias("parent"), F.lit(0).alias("hops"))
    return reduce(DataFrame.unionByName, emitted)
