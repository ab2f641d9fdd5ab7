"""O5 ``resolve_in_graph``: graph-aware alias resolution.

Per request ``(request_id, root, target)`` inside the graph of ``root``:

1. seed: an edge with the root in ``_path``, the target on its leaf end
   (``_from`` inbound, ``_to`` outbound) and a predicate in
   ``allowed = traverse + [predicate]``. No seed -> ``not_in_graph``.
2. a functional seed (predicate == ``predicate``) wins: the target itself is
   canonical (``not_found`` when it has no document), ``hops = 0``.
3. otherwise walk from the target in the traversal direction over allowed
   edges, at most ``levels`` hops, vertices unique per path; the far end of
   the first functional edge is the answer. Fewest hops wins, then the
   smallest handle. Nothing within ``levels`` -> ``unresolved``.

Only non-functional edges are walked between hops (the first functional
edge on a path ends it). The loop runs once per distinct (root, target)
pair, and the answers are joined back to the requests at the end.

The walk visits a vertex once per pair and keeps its smallest path. That path
may hold the far end of a functional edge although another path to the same
vertex avoids it. Such an edge is put aside as ``(pair, far)`` and decided by
a second walk that leaves out the vertex ``far``: its first arrival at a
functional edge into ``far`` is the shortest path with unique vertices that
ends there, so one visit per vertex is exact in it. An answer of either walk
counts; fewest hops win.

Every hop is one aggregation (hits, edges put aside and the next frontier
together), written once; its observed counts size the next broadcast. Vertices
are numbers in the order of their handles, paths arrays of them, and what a hop
visited stays in its buckets (see ``plans/loopstate.py``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.functions.constants import (
    DEFAULT_TRAVERSE,
    ENUM_OF,
    INBOUND,
    NOT_FOUND,
    NOT_IN_GRAPH,
    OK,
    UNRESOLVED,
)
from dictgraph.functions.keys import handle
from dictgraph.operators._util import join_back
from dictgraph.operators.expand import check_levels
from dictgraph.operators.search import restrict_to_tokens
from dictgraph.plans.graph import PublishedEdges, check_direction, edges_by_root, is_large, usable_from_published
from dictgraph.plans.lineage import cut_lineage, cut_lineage_counted, cut_lineage_observed
from dictgraph.plans.loopstate import HUB_EDGES, LoopTables, Visited, prepare
from dictgraph.plans.sizing import DEFAULT_MAX_BROADCAST_BYTES, LOOP_MAX_BROADCAST_ROWS, broadcast_small
from dictgraph.sources.dictionary import prepare_terms

MAX_LEVELS = 100
PATH_STEP_BYTES = 48  # of a path's vertex: a handle, where vertices are no numbers


def _walk(tables: LoopTables, frontier: DataFrame, graph, max_levels: int, max_broadcast_rows: int):
    """Hits ``(pair, canonical_h, hops)`` of each hop, and the functional edges
    put aside as ``(pair, avoid)`` (None without any).

    With a column ``avoid`` in the frontier, each ``(pair, avoid)`` walks by
    itself around that vertex, and only functional edges into it are hits."""
    around = "avoid" in frontier.columns
    keys = ["pair", "avoid"] if around else ["pair"]
    size = F.coalesce(F.sum(64 + PATH_STEP_BYTES * F.size("path")), F.lit(0))
    frontier, stats = cut_lineage_observed(frontier, bytes=size, walks=F.count(F.lit(1)))
    visited = Visited(tables, [*keys, "vertex"])
    visited.add(frontier, stats["rows"])
    found, aside = [], []
    for hop in range(1, max_levels + 1):
        if stats["walks"] == 0:
            break
        # Frontier rows carry their path (up to ``levels`` numbers): the
        # broadcast check takes rows and path bytes.
        small = stats["walks"] <= max_broadcast_rows and stats["bytes"] <= DEFAULT_MAX_BROADCAST_BYTES
        step = graph.step(frontier, small)
        onto = F.array_contains("path", F.col("far"))
        hit = F.col("functional") & ((F.col("far") == F.col("avoid")) if around else ~onto)
        put_aside = F.lit(False) if around else F.col("functional") & onto
        walked = ~F.col("functional") & ~onto
        if around:
            walked = walked & (F.col("far") != F.col("avoid"))
        path = F.slice("path", 1, 0) if around else F.concat("path", F.array("far"))  # the second walk needs no path
        cand = step.select(
            *keys,
            F.col("far").alias("vertex"),
            F.when(walked, F.struct(path.alias("path"), "root_h")).alias("b"),
            hit.alias("hit"),
            put_aside.alias("aside"),
        )
        # One aggregation: the smallest path per (pair, vertex) is kept, and hits
        # are flagged on their far end; vertices visited before walk no further.
        merged = (
            visited.aggregate(cand, hit=F.max("hit"), aside=F.max("aside"), b=F.min("b"))
            .withColumn("walk", ~F.col("seen") & F.col("b").isNotNull())
            .filter("hit or aside or walk")
            .select(*keys, "vertex", "hit", "aside", "walk", F.col("b.root_h").alias("root_h"), F.col("b.path").alias("path"))
        )
        merged, stats = visited.keep(
            merged,
            hits=F.count(F.when(F.col("hit"), 1)),
            aside=F.count(F.when(F.col("aside"), 1)),
            walks=F.count(F.when(F.col("walk"), 1)),
            bytes=F.coalesce(F.sum(F.when(F.col("walk"), 64 + PATH_STEP_BYTES * F.size("path"))), F.lit(0)),
        )
        frontier = merged.filter("walk").select(*keys, "root_h", "vertex", "path")
        if stats["aside"]:
            aside.append(merged.filter("aside").select("pair", F.col("vertex").alias("avoid")))
        if stats["hits"]:
            found.append(
                merged.filter("hit").groupBy("pair").agg(F.min("vertex").alias("canonical_h")).withColumn("hops", F.lit(hop))
            )
            # pairs resolved at this hop leave the frontier
            done = broadcast_small(merged.filter("hit").select(*keys).distinct(), stats["hits"], max_broadcast_rows)
            frontier = frontier.join(done, keys, "left_anti")
        visited.add(merged.filter("walk"), stats["walks"])
    return found, reduce(DataFrame.unionByName, aside).distinct() if aside else None


def resolve_in_graph(
    requests: DataFrame,
    edges: DataFrame,
    terms: DataFrame,
    predicate: str | None = ENUM_OF,
    direction: str = INBOUND,
    traverse=None,
    levels: int | None = 10,
    with_doc: bool = True,
    max_broadcast_rows: int = LOOP_MAX_BROADCAST_ROWS,
    usable_edges: DataFrame | None = None,
    hub_edges: int = HUB_EDGES,
) -> DataFrame:
    """Requests plus ``resolved_gid``, ``status``, ``hops`` (and ``doc``).
    Requests are keyed by their ``(root, target)``; other columns (such as
    ``request_id``) are carried through. ``usable_edges`` reads a published
    ``edges_by_root`` table (O15) instead of exploding ``edges`` again."""
    pred = predicate or ENUM_OF
    direction = check_direction(direction)
    trav = list(DEFAULT_TRAVERSE) if not isinstance(traverse, (list, tuple)) else list(traverse)
    allowed = trav if pred in trav else trav + [pred]
    max_levels = check_levels(levels, MAX_LEVELS, 10)

    # Requests sharing (root, target) are resolved once: the loop runs over
    # distinct pairs (aggregated map-side, so a hot target never lands whole
    # in one task) and the answers are joined back by pair at the end.
    pair_key = F.concat_ws("\u0001", handle("root"), handle("target"))
    req = (
        requests.select(pair_key.alias("request_id"), handle("root").alias("root_h"), handle("target").alias("target_h"))
        .filter(F.col("root_h").isNotNull() & F.col("target_h").isNotNull())
        .distinct()
    )
    req, n_pairs = cut_lineage_counted(req.withColumn("pair", F.monotonically_increasing_id()))
    tables = LoopTables(requests.sparkSession)
    try:
        answered = _answers(tables, req, n_pairs, edges, usable_edges, terms, pred, allowed, direction, max_levels, max_broadcast_rows, with_doc, hub_edges)
        result = join_back(requests.withColumn("__pair", pair_key), answered, "__pair", payload="doc" if with_doc else None)
    finally:
        tables.close()  # join_back has written the answers elsewhere
    return result.drop("__pair").withColumn("status", F.coalesce("status", F.lit(NOT_IN_GRAPH)))


def _answers(tables, req, n_pairs, edges, published, terms, pred, allowed, direction, max_levels, max_broadcast_rows, with_doc, hub_edges) -> DataFrame:
    """``(__pair, resolved_gid, status, hops[, doc])`` of the distinct pairs."""
    numbers = None
    pairs = req.select("pair", "root_h", "target_h")
    roots = pairs.select("root_h")
    functional = F.col("predicate") == pred
    if published is not None and is_large(published):
        # read per step with the vertices pushed into the scan (targets for the
        # seeds, the frontier for each hop)
        usable = usable_from_published(published, allowed, direction, roots).withColumn("functional", functional)
        graph = PublishedEdges(usable.select("root_h", "near", "far", "functional"))
        seed_edges = restrict_to_tokens(usable, pairs.select(F.col("target_h").alias("far")), column="far")
    else:
        usable = usable_from_published(published, allowed, direction, roots) if published is not None else edges_by_root(edges, allowed, direction, roots)
        usable = usable.select("root_h", "near", "far", functional.alias("functional"))
        graph, started, numbers = prepare(tables, usable, pairs.withColumnRenamed("target_h", "vertex"), n_pairs, hub_edges, max_broadcast_rows)
        pairs = started.withColumnRenamed("vertex", "target_h")
        seed_edges = graph.rows

    # Seeds: the target on the leaf end, i.e. the ``far`` end of the walk.
    seeds = pairs.join(
        seed_edges.select("root_h", F.col("far").alias("target_h"), "functional"), ["root_h", "target_h"]
    ).groupBy("pair").agg(F.max("functional").alias("functional_seed"))
    seeded = cut_lineage(pairs.join(seeds, "pair", "left"))

    direct = seeded.filter(F.col("functional_seed")).select("pair", F.col("target_h").alias("canonical_h"), F.lit(0).alias("hops"))
    start = seeded.select("pair", "root_h", F.col("target_h").alias("vertex"), F.array("target_h").alias("path"), "functional_seed")
    found, aside = _walk(tables, start.filter(~F.col("functional_seed")).drop("functional_seed"), graph, max_levels, max_broadcast_rows)
    if aside is not None:
        again = aside.join(start.drop("functional_seed"), "pair").filter(F.col("avoid") != F.col("vertex"))  # the start is on every path
        found += _walk(tables, again.select("pair", "avoid", "root_h", "vertex", "path"), graph, max_levels, max_broadcast_rows)[0]

    answers = (
        reduce(DataFrame.unionByName, [direct] + found)
        .groupBy("pair")
        .agg(F.min(F.struct("hops", "canonical_h")).alias("best"))
        .select("pair", "best.*")
    )
    if numbers is not None:
        answers = numbers.back(answers, "canonical_h")
    seeded = req.select("request_id", "pair").join(seeded.select("pair", "functional_seed"), "pair")
    out = seeded.join(answers, "pair", "left")
    docs = prepare_terms(terms)
    payload = [handle("_key").alias("canonical_h"), F.col("_key").alias("__key")]
    if with_doc:
        payload.append("doc")
    out = out.join(docs.select(*payload), "canonical_h", "left")
    status = (
        F.when(F.col("functional_seed").isNull(), F.lit(NOT_IN_GRAPH))
        .when(F.col("canonical_h").isNull(), F.lit(UNRESOLVED))
        .when(F.col("__key").isNull(), F.lit(NOT_FOUND))
        .otherwise(F.lit(OK))
    )
    cols = ["request_id", F.col("__key").alias("resolved_gid"), status.alias("status"), "hops"]
    if with_doc:
        cols.append("doc")
    return out.select(*cols).withColumnRenamed("request_id", "__pair")
