"""State of the graph loops (O3, O5): numbered vertices, and rows that stay put.

Inside a loop that carries paths for many pairs a vertex is a long. Numbers
follow the order of the handles, so every tie-break on handles holds on numbers;
handles are attached at the end.

While a loop's state is small (LOOSE_ROWS), each hop is a checkpoint, and what
was visited joins the hop's aggregation. Beyond that, what a hop adds is written
once, bucketed on the loop's key, into the session's checkpoint folder, and read
back as a bucketed relation. Candidates of a later hop are aggregated on the same
key and so lie where the earlier rows already are: those are neither shuffled
again nor rewritten. Edges that are too many to broadcast are bucketed on (root,
near, salt) once a frontier is too large to broadcast. The edges of a hub vertex
are dealt over several salts and the few frontier rows at a hub are copied to
each, so no bucket holds a whole hub, and the frontier is the only side that
moves. Where many frontier rows crowd at a vertex of few edges, these are
broadcast and the rows stay. Sizes decide where rows lie, never which rows there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dictgraph.plans.lineage import cut_lineage_observed
from dictgraph.plans.numbering import ordered_ids
from dictgraph.plans.sizing import DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_MAX_BROADCAST_ROWS, broadcast_if_bounded
from dictgraph.session import ensure_checkpoint_dir

# Edges of one (root, vertex) in a graph above which they are dealt over salts.
HUB_EDGES = 200_000
# Frontier rows at one vertex above which they stay and its edges come to them.
CROWD_ROWS = 200_000
# Pieces of the visited set that are looked through before they become one.
MAX_PIECES = 8
# Visited rows that a hop may move again.
LOOSE_ROWS = 2_000_000
# Edges of a vertex, on average, from which on they are ranked: fewer make too
# few candidates of a frontier to pay for the ranking.
RANKED_DEGREE = 2
# Pairs from which on a loop runs on numbers.
NUMBERED_PAIRS = 1_000_000


class LoopTables:
    """Bucketed relations of one loop. ``close`` deletes their files: the loop's
    result has to be cut off from them before, or made of lasting ones alone."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.run = uuid.uuid4().hex
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/loop-{self.run}"
        self.made, self.lasting = 0, []

    def keep(self, df: DataFrame, keys: Sequence[str], deal: bool = True, lasting: bool = False, **metrics) -> tuple[DataFrame, dict]:
        """``df`` written in buckets of ``keys``, and its ``rows`` and ``metrics``
        (aggregates), observed on the way. ``deal=False`` for rows that already
        lie by ``keys``. ``lasting`` rows may be part of the loop's result."""
        if deal:
            df = df.repartition(self.buckets, *keys)
        seen = Observation(f"loop_{uuid.uuid4().hex}")
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])
        self.made += 1
        if lasting:
            self.lasting.append(self.made)
        name = f"dictgraph_loop_{self.run}_{self.made}"
        # The catalog is the way to a bucketed relation; its entry goes at once,
        # the relation and the files stay.
        df.write.format("parquet").bucketBy(self.buckets, *keys).option("path", f"{self.folder}/{self.made}").saveAsTable(name)
        try:
            out = self.spark.table(name)
            out.schema  # resolved now: the relation no longer needs its entry
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return out, dict(seen.get)

    def close(self, lasting: bool = False) -> None:
        """Delete the files; with ``lasting`` all but those of lasting rows, which
        the result reads in place and which go when the driver ends."""
        try:
            jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        except Exception:  # Spark Connect gives no handle to the file system
            return
        stays = set(self.lasting) if lasting else set()
        folder = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = folder.getFileSystem(conf)
        if stays:
            files.deleteOnExit(folder)
        for path in [f"{self.folder}/{n}" for n in range(1, self.made + 1) if n not in stays] if stays else [self.folder]:
            files.delete(jvm.org.apache.hadoop.fs.Path(path), True)


class Visited:
    """The keys a loop has been at: a few loose rows that join the aggregation of
    a hop, and pieces bucketed on the keys."""

    def __init__(self, tables: LoopTables, keys: Sequence[str], loose_rows: int | None = None):
        self.tables, self.keys = tables, list(keys)
        self.most = LOOSE_ROWS if loose_rows is None else loose_rows
        self.loose, self.rows, self.pieces = [], 0, []

    def keep(self, df: DataFrame, lasting: bool = False, **metrics) -> tuple[DataFrame, dict]:
        """``df``, aggregated on the keys, written; its ``rows`` and ``metrics``."""
        if self.pieces:
            return self.tables.keep(df, self.keys, deal=False, lasting=lasting, **metrics)
        return cut_lineage_observed(df, **metrics)

    def add(self, piece: DataFrame, rows: int) -> None:
        piece = piece.select(*self.keys)
        if self.pieces:
            self.pieces.append(piece)
            if len(self.pieces) > MAX_PIECES:
                self.pieces = [self.tables.keep(reduce(DataFrame.unionByName, self.pieces), self.keys)[0]]
            return
        self.loose.append(piece)
        self.rows += rows
        if self.rows > self.most:  # moved once more, then never again
            self.pieces = [self.tables.keep(reduce(DataFrame.unionByName, self.loose), self.keys)[0]]
            self.loose = []

    def aggregate(self, candidates: DataFrame, **aggregates) -> DataFrame:
        """One row per key of the candidates: ``aggregates`` and the boolean
        ``seen``, whether the loop has been there."""
        rows = candidates.withColumn("seen", F.lit(False))
        if self.loose:
            rows = rows.unionByName(reduce(DataFrame.unionByName, self.loose).withColumn("seen", F.lit(True)), allowMissingColumns=True)
        rows = rows.groupBy(*self.keys).agg(F.max("seen").alias("seen"), *[c.alias(n) for n, c in aggregates.items()])
        marks = [F.col("seen")]
        for i, piece in enumerate(self.pieces):
            marks.append(F.coalesce(F.col(f"__seen{i}"), F.lit(False)))
            rows = rows.join(piece.withColumn(f"__seen{i}", F.lit(True)), self.keys, "left")
        return rows.withColumn("seen", reduce(lambda a, b: a | b, marks)).drop(*[f"__seen{i}" for i in range(len(self.pieces))])


class Numbers:
    """Longs for handles, in the handles' order."""

    def __init__(self, handles: DataFrame, roots: DataFrame | None = None):
        """``handles``: one column ``h``; nulls get no number. ``roots``: all
        values of a column ``root_h``, few as a rule: a join that dealt a graph's
        rows by its root would put them into one task."""
        rows, stats = cut_lineage_observed(
            ordered_ids(handles.filter(F.col("h").isNotNull()).distinct(), ("h",), "number"),
            bytes=F.coalesce(F.sum(F.octet_length("h") + 40), F.lit(0)),
        )
        small = stats["rows"] <= DEFAULT_MAX_BROADCAST_ROWS and stats["bytes"] <= DEFAULT_MAX_BROADCAST_BYTES
        self.rows = F.broadcast(rows) if small else rows
        self.roots = self.rows
        if roots is not None and not small:
            asked = broadcast_if_bounded(roots.select(F.col("root_h").alias("h")).distinct())
            self.roots = broadcast_if_bounded(rows.join(asked, "h", "left_semi"))

    def of(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with the handles in ``columns`` replaced by their numbers; rows
        with a handle that has none are dropped."""
        for c in columns:
            known = self.roots if c == "root_h" else self.rows
            df = df.join(known.select(F.col("h").alias(c), F.col("number").alias("__n")), c).drop(c).withColumnRenamed("__n", c)
        return df

    def back(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with numbers in ``columns`` replaced by handles (null: null)."""
        for c in columns:
            df = df.join(self.rows.select(F.col("number").alias(c), F.col("h").alias("__h")), c, "left").drop(c).withColumnRenamed("__h", c)
        return df


class LoopEdges:
    """Edges of a loop: written once, and bucketed by (root_h, near, salt) when
    a frontier first is too large to be broadcast to them."""

    def __init__(
        self, tables: LoopTables, edges: DataFrame, hub_edges: int = HUB_EDGES, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
        rank: Sequence[str] = (), **metrics,
    ):
        """``rank``: a column that only orders edges, and those that order them
        further. Where a hop makes several rows of one, it becomes a long in that
        order once the edges are bucketed: every candidate carries it."""
        self.tables, self.hub_edges, self.rank = tables, hub_edges, list(rank)
        if rank:  # a size alone hangs on it
            metrics["nears"] = F.approx_count_distinct("near")
        text = [f.name for f in edges.schema.fields if f.dataType.simpleString() == "string"]
        self.size = sum((F.octet_length(c) for c in text), F.lit(100))
        self.crowd_rows = CROWD_ROWS
        self.rows, self.stats = cut_lineage_observed(edges, bytes=F.coalesce(F.sum(self.size), F.lit(0)), **metrics)
        self.small = self.stats["rows"] <= max_broadcast_rows and self.stats["bytes"] <= DEFAULT_MAX_BROADCAST_BYTES
        self.bucketed, self.hubs = None, None

    def _bucketed(self) -> DataFrame:
        if self.bucketed is None:
            rows, keys = self.rows, ["root_h", "near"]
            ranked = self.rank and self.stats["rows"] >= RANKED_DEGREE * self.stats["nears"]
            if ranked:
                rows = ordered_ids(rows, self.rank, "__rank").drop(self.rank[0]).withColumnRenamed("__rank", self.rank[0])
            if self.stats["rows"] > self.hub_edges:
                hubs = self.rows.groupBy("root_h", "near").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > self.hub_edges)
                salts = F.least(F.ceil(F.col("n") / self.hub_edges), F.lit(self.tables.buckets)).cast("int")
                hubs, found = cut_lineage_observed(hubs.select("root_h", "near", salts.alias("salts")))
                if found["rows"]:  # at most one hub for each hub_edges edges
                    self.hubs = F.broadcast(hubs)
                    salt = F.pmod(F.xxhash64("far"), F.coalesce("salts", F.lit(1))).cast("int")
                    rows = rows.join(self.hubs, ["root_h", "near"], "left").withColumn("salt", salt).drop("salts")
                    keys.append("salt")
            self.bucketed, _ = self.tables.keep(rows, keys)
            if ranked:  # all edges of a hop are ranked, or none
                self.rows = self.bucketed.drop("salt")
        return self.bucketed

    def step(self, frontier: DataFrame, small: bool) -> DataFrame:
        """``frontier`` (``root_h``, ``vertex``, ...) joined with the edges that
        leave its vertices. A small frontier is broadcast, or else few edges;
        failing that the frontier's rows alone move, but for those that crowd at
        a vertex: its edges, if few, are broadcast to them."""
        fr = frontier.withColumnRenamed("vertex", "near")
        if small:
            return F.broadcast(fr).join(self.rows, ["root_h", "near"])
        if self.small:
            return fr.join(F.broadcast(self.rows), ["root_h", "near"])
        crowds, others = self._crowds(fr)
        if crowds is None:
            return self._moved(fr)
        if others:
            self._bucketed()
        edges, stats = cut_lineage_observed(self.rows.join(crowds, ["root_h", "near"]), bytes=F.coalesce(F.sum(self.size), F.lit(0)))
        if stats["rows"] > DEFAULT_MAX_BROADCAST_ROWS or stats["bytes"] > DEFAULT_MAX_BROADCAST_BYTES:
            return self._moved(fr)
        out = fr.join(F.broadcast(edges), ["root_h", "near"])
        return out.unionByName(self._moved(fr.join(crowds, ["root_h", "near"], "left_anti"))) if others else out

    def _crowds(self, fr: DataFrame) -> tuple[DataFrame | None, int]:
        """The vertices at which more than ``crowd_rows`` rows stand (None
        without any), at most one for each so many, and the rows at others."""
        n, seen = F.count(F.lit(1)).alias("n"), Observation(f"crowds_{uuid.uuid4().hex}")
        at = fr.groupBy("root_h", "near").agg(n)
        at = at.observe(seen, F.sum(F.when(F.col("n") <= self.crowd_rows, F.col("n")).otherwise(0)).alias("others"))
        crowds, found = cut_lineage_observed(at.filter(F.col("n") > self.crowd_rows).select("root_h", "near"))
        return (F.broadcast(crowds) if found["rows"] else None), int(seen.get["others"] or 0)

    def _moved(self, fr: DataFrame) -> DataFrame:
        edges = self._bucketed()
        if self.hubs is None:
            return fr.join(edges, ["root_h", "near"])
        fr = fr.join(self.hubs, ["root_h", "near"], "left")
        fr = fr.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        return fr.join(edges, ["root_h", "near", "salt"]).drop("salt")


def prepare(tables: LoopTables, usable: DataFrame, pairs: DataFrame, n_pairs: int, hub_edges: int, max_broadcast_rows: int, **metrics):
    """``(graph, pairs, numbers)`` of a loop: its edges, the pairs (``pair``,
    ``root_h``, ``vertex``) that start it, and the numbers that both are on
    (None: handles)."""
    bound = max(max_broadcast_rows, 0)
    # Numbering moves every edge once for each end; only many walks with paths
    # make up for it.
    if n_pairs <= NUMBERED_PAIRS:
        return LoopEdges(tables, usable, hub_edges, bound, **metrics), pairs, None
    ends = usable.select(F.explode(F.array("near", "far")).alias("h"))
    numbers = Numbers(ends.union(pairs.select("root_h")).union(pairs.select("vertex")), pairs)
    graph = LoopEdges(tables, numbers.of(usable, "near", "far", "root_h"), hub_edges, bound, **metrics)
    return graph, numbers.of(pairs, "root_h", "vertex"), numbers
