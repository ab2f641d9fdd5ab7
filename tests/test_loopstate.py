"""The loops' state beyond its small sizes: numbers, buckets, salted hubs."""

import random

import pytest
from pyspark.sql import functions as F

from dictgraph import expand_enum, resolve_in_graph
from dictgraph.plans import loopstate as LS
from dictgraph.plans.publish import drop_dictionary, publish_dictionary
from tests.fixtures import make_edges, make_terms, req
from tests.test_expand import random_graph
from tests.test_plans import plan, tree


@pytest.fixture
def large(monkeypatch):
    """Every size counts as large."""
    monkeypatch.setattr(LS, "LOOSE_ROWS", 0)
    monkeypatch.setattr(LS, "NUMBERED_PAIRS", -1)
    monkeypatch.setattr(LS, "MAX_PIECES", 2)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("direction", ["inbound", "outbound"])
def test_large_state_gives_the_same_rows(spark, large, monkeypatch, direction):
    rng = random.Random(17)
    spec = random_graph(rng, n_vertices=14, n_edges=46)
    spec += [(f"w{i}", "_predicate_enum-of", "v3", ["R1"]) for i in range(40)]  # a hub
    spec += [("v3", "_predicate_bridge-of", f"w{i}", ["R1"]) for i in range(0, 40, 3)]
    edges = make_edges(spark, spec)
    terms = make_terms(spark, [{"_code": {"_gid": f"v{i}"}, "_info": {}} for i in range(0, 14, 2)])
    data = [(i, r, f"v{v}") for i, (r, v) in enumerate((r, v) for r in ("R1", "R2", "none") for v in range(14))]
    er = req(spark, data + data[:3] + [(99, "R1", "unknown"), (98, None, "v1")], "request_id long, root string, branch string")
    rr = er.withColumnRenamed("branch", "target")
    got_e = rows(expand_enum(er, edges, levels=6, direction=direction, max_broadcast_rows=0, hub_edges=5))
    got_p = rows(expand_enum(er, edges, levels=6, direction=direction, max_broadcast_rows=0, hub_edges=5, by_pair=True))
    got_r = rows(resolve_in_graph(rr, edges, terms, levels=8, direction=direction, with_doc=False, max_broadcast_rows=0, hub_edges=5))
    got_b = rows(expand_enum(er, edges, levels=6, direction=direction))  # numbered, broadcast
    monkeypatch.undo()
    want = rows(expand_enum(er, edges, levels=6, direction=direction))
    assert got_e == want and got_b == want and len(want) > 100
    assert got_p == rows(expand_enum(er, edges, levels=6, direction=direction, by_pair=True))
    assert got_r == rows(resolve_in_graph(rr, edges, terms, levels=8, direction=direction, with_doc=False))


def test_large_published_tables_are_read_per_hop(spark, large, monkeypatch):
    from dictgraph.plans import graph

    rng = random.Random(23)
    edges = make_edges(spark, random_graph(rng, n_vertices=12, n_edges=40))
    terms = make_terms(spark, [{"_code": {"_gid": f"v{i}"}, "_info": {}} for i in range(12)])
    publish_dictionary(spark, terms, edges, "dgk_", num_ranges=4)
    try:
        u = spark.table("dgk_edges_by_root")
        assert not graph.is_large(u)
        data = [(i, "R1", f"v{i}") for i in range(12)]
        er, rr = req(spark, data, "request_id long, root string, branch string"), req(spark, data, "request_id long, root string, target string")
        want = rows(expand_enum(er, edges, levels=4)), rows(resolve_in_graph(rr, edges, terms, with_doc=False))
        monkeypatch.setattr(graph, "LARGE_TABLE_BYTES", 0)
        assert graph.is_large(u)
        assert (rows(expand_enum(er, None, levels=4, usable_edges=u)), rows(resolve_in_graph(rr, None, terms, with_doc=False, usable_edges=u))) == want
    finally:
        drop_dictionary(spark, "dgk_")


def test_large_published_tables_without_bridges(spark, monkeypatch):
    from dictgraph.plans import graph

    spec = [(f"w{i}", "_predicate_enum-of", f"v{i % 4}", ["R1"]) for i in range(40)]
    spec += [(f"v{i}", "_predicate_section-of", "R1", ["R1"]) for i in range(4)] + [("x", "_predicate_bridge-of", "R2", ["R2"])]
    edges = make_edges(spark, spec + [(f"z{i}", "_predicate_enum-of", "w0", ["R1"]) for i in range(3)])
    graph.edges_by_root(edges, None).write.mode("overwrite").saveAsTable("dgn_edges")
    try:
        usable = spark.table("dgn_edges")
        er = req(spark, [(0, "R1"), (1, "R1")], "request_id long, root string")
        want = rows(expand_enum(er, edges, levels=2))
        monkeypatch.setattr(graph, "LARGE_TABLE_BYTES", 0)
        hops, step = [], graph.PublishedEdges.step
        monkeypatch.setattr(graph.PublishedEdges, "step", lambda self, *a: hops.append(a) or step(self, *a))
        assert rows(expand_enum(er, None, levels=2, usable_edges=usable)) == want and len(want) == 88
        assert len(hops) == 2  # no hop for bridges that R1 has not
        assert rows(expand_enum(er.replace("R1", "R2"), None, levels=1, usable_edges=usable)) == []
        assert len(hops) == 3 + 1  # a bridge, then nothing behind it
        # vertices too many to be broadcast: the edges move once, for the join
        monkeypatch.setattr("dictgraph.operators.search.MAX_PUSHED_TOKENS", 1)
        monkeypatch.setattr(graph, "is_bounded", lambda df: False)
        frontier = spark.createDataFrame([("terms/R1", f"terms/v{i}") for i in range(4)], "root_h string, vertex string")
        out = graph.PublishedEdges(usable).step(frontier, False)
        assert out.count() == 40 and not [line for line in tree(plan(out)) if "LeftSemi" in line]
    finally:
        spark.sql("DROP TABLE IF EXISTS dgn_edges")


def exchanges(df):
    return [line for line in tree(plan(df)) if "Exchange" in line and "Broadcast" not in line]


def test_visited_rows_and_edges_do_not_move(spark):
    """Past the loose rows a hop shuffles its candidates alone, and a frontier
    too large to broadcast is all that goes to the edges."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = LS.LoopTables(spark)
    try:
        visited = LS.Visited(tables, ["pair", "vertex"], loose_rows=10)
        cand = spark.range(2000).selectExpr("id % 50 AS pair", "id % 700 AS vertex", "id AS x")
        counts = []
        for hop in range(5):
            hop_rows = visited.aggregate(cand.where(f"x % 5 = {hop}"), b=F.min("x"))
            counts.append(len(exchanges(hop_rows)))
            new, stats = visited.keep(hop_rows.filter(~F.col("seen")))
            visited.add(new, stats["rows"])
        assert counts[0] == 1 and counts[1:] == [1] * 4  # the same one exchange however many hops came before
        assert len(visited.pieces) == 5 and not visited.loose
        assert sum(p.count() for p in visited.pieces) == cand.select("pair", "vertex").distinct().count()

        edges = LS.LoopEdges(tables, spark.range(3000).selectExpr("id % 2 AS root_h", "id % 100 AS near", "id AS far"), hub_edges=1000, max_broadcast_rows=0)
        step = edges.step(spark.range(500).selectExpr("id % 2 AS root_h", "id AS vertex"), small=False)
        assert len(exchanges(step)) == 1 and step.count() == 3000
        salted = LS.LoopEdges(tables, spark.range(3000).selectExpr("id % 2 AS root_h", "id % 3 AS near", "id AS far"), hub_edges=100, max_broadcast_rows=0)
        step = salted.step(spark.range(500).selectExpr("id % 2 AS root_h", "id AS vertex"), small=False)
        assert len(exchanges(step)) == 1 and step.count() == 1500
    finally:
        tables.close()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_hub_edges_are_dealt_over_buckets(spark):
    tables = LS.LoopTables(spark, buckets=8)
    try:
        raw = spark.range(4000).selectExpr("0L AS root_h", "CASE WHEN id < 3000 THEN 7 ELSE id END AS near", "id AS far")
        edges = LS.LoopEdges(tables, raw, hub_edges=400, max_broadcast_rows=0)
        step = edges.step(spark.createDataFrame([(0, 7), (0, 3500)], "root_h long, vertex long"), small=False)
        assert step.count() == 3001
        sizes = [r["count"] for r in edges.bucketed.groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1800 and edges.hubs.collect()[0]["salts"] == 8
    finally:
        tables.close()
    path = spark._jvm.org.apache.hadoop.fs.Path(tables.folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("dictgraph_loop_")]


def test_expansion_moves_and_keeps_little(spark, large, monkeypatch):
    """Edges' keys become longs, request ids are the loop's own key, the last
    hop makes no candidate that is not emitted, and the result is not copied."""
    rng = random.Random(5)
    spec = random_graph(rng, n_vertices=12, n_edges=60)
    edges = make_edges(spark, spec)
    er = req(spark, [(f"q{v}", "R1", f"v{v}") for v in range(12)], "request_id string, root string, branch string")
    steps, aggregate = [], LS.Visited.aggregate
    monkeypatch.setattr(LS.Visited, "aggregate", lambda self, c, **a: steps.append(c) or aggregate(self, c, **a))
    made, init = [], LS.LoopTables.__init__
    monkeypatch.setattr(LS.LoopTables, "__init__", lambda self, *a: made.append(self) or init(self, *a))
    monkeypatch.setattr(LS, "DEFAULT_MAX_BROADCAST_ROWS", -1)
    out = expand_enum(er, edges, levels=3, max_broadcast_rows=0, hub_edges=5)
    got = rows(out)
    assert len(steps) == 4 and all(dict(c.dtypes)["ekey"] == "bigint" for c in steps)
    assert dict(steps[0].dtypes)["pair"] == "string"
    text = plan(out)
    assert "Join" not in text and "parquet" in text.lower()  # neither joined with the ids nor written again
    files = spark._jvm.org.apache.hadoop.fs.Path(made[0].folder)
    kept = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(files)
    assert sorted(int(f.getPath().getName()) for f in kept) == made[0].lasting and made[0].made > len(kept)
    none = expand_enum(er.withColumn("branch", F.lit("unknown")), edges, levels=3)
    assert none.count() == 0 and none.dtypes == out.dtypes
    monkeypatch.undo()
    want = rows(expand_enum(er, edges, levels=3))
    assert got == want and len(want) > 60
    # an id that comes twice, or is null, is joined as before
    twice = er.unionByName(req(spark, [("q1", "R1", "v2"), (None, "R1", "v3")], er.schema))
    both = rows(expand_enum(twice, edges, levels=3).filter("request_id IS NOT NULL"))
    assert both == sorted(want + [("q1", *r[1:]) for r in want if r[0] == "q2"], key=repr)


def test_numbers_follow_the_handles(spark):
    handles = ["terms/b", "terms/a", "terms/a10", "terms/a9", "terms/é", None, "terms/a"]
    numbers = LS.Numbers(spark.createDataFrame([(h,) for h in handles], "h string"))
    got = [r.h for r in numbers.rows.orderBy("number").collect()]
    assert got == sorted({h for h in handles if h})
    df = spark.createDataFrame([("terms/a", "terms/é", 1), ("terms/none", "terms/a", 2)], "x string, y string, z int")
    there = numbers.of(df, "x", "y")
    assert rows(numbers.back(there, "x", "y").select("x", "y", "z")) == [("terms/a", "terms/é", 1)]


def widest(df):
    from pyspark.sql.functions import spark_partition_id

    return df.groupBy(spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_rows_that_crowd_at_a_vertex_stay(spark, monkeypatch):
    monkeypatch.setattr(LS, "CROWD_ROWS", 20)
    monkeypatch.setattr(LS, "LOOSE_ROWS", 0)
    spec = [(f"w{i}", "_predicate_enum-of", f"n{i % 2}" if i < 100 else f"m{i}", ["R1"]) for i in range(130)]
    spec += [(f"n{i}", "_predicate_enum-of", "top", ["R1"]) for i in range(2)] + [("top", "_predicate_section-of", "R1", ["R1"])]
    edges = make_edges(spark, spec)
    er = req(spark, [(i, "R1", f"w{i}") for i in range(130)], "request_id long, root string, branch string")
    moved, move = [], LS.LoopEdges._moved
    monkeypatch.setattr(LS.LoopEdges, "_moved", lambda self, fr: moved.append(fr.count()) or move(self, fr))
    monkeypatch.setattr(LS.LoopEdges, "small", property(lambda self: False, lambda self, v: None), raising=False)
    got = rows(expand_enum(er, edges, levels=4, direction="outbound", max_broadcast_rows=10))
    assert moved == [130, 30]  # at n0, n1 and top the edges come to the rows
    monkeypatch.undo()
    assert got == rows(expand_enum(er, edges, levels=4, direction="outbound")) and len(got) > 300


def test_a_graph_is_not_dealt_by_its_root(spark, large):
    from dictgraph.plans.graph import edges_by_root

    edges = make_edges(spark, [(f"w{i}", "_predicate_enum-of", f"v{i % 50}", ["R1"]) for i in range(400)]).repartition(8)
    roots = req(spark, [("terms/R1",)], "root_h string")
    usable = edges_by_root(edges, None, roots=roots)
    assert widest(usable) < 200
    tables = LS.LoopTables(spark)
    pairs = req(spark, [(i, "terms/R1", f"terms/w{i}") for i in range(3)], "pair long, root_h string, vertex string")
    graph, _, numbers = LS.prepare(tables, usable.repartition(8), pairs, 3, 1000, 10)
    assert numbers is not None and graph.rows.count() == 400 and widest(graph.rows) < 300


def test_derived_rows_are_dealt_evenly(spark, tmp_path):
    from dictgraph.plans.sizing import spread_rows

    spark.range(1000).selectExpr("1 AS k", "CAST(NULL AS STRING) AS v").coalesce(1).write.parquet(str(tmp_path / "t"))
    out = spread_rows(spark.read.parquet(str(tmp_path / "t")), 100)
    assert out.columns == ["k", "v"] and out.count() == 1000 and out.rdd.getNumPartitions() == 10 and widest(out) < 250


def test_work_stays_behind_the_deal(spark, tmp_path):
    from dictgraph.operators.search import text_index_frame
    from dictgraph.plans.sizing import spread_rows
    from dictgraph.sources.dictionary import terms_from_json

    spark.range(300).selectExpr("concat('k', id) AS _key", """concat('{"a":', id, '}') AS doc""").coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    parsed, words = terms_from_json(spread_rows(t, 100)), text_index_frame(t, "_key", "doc")
    for out in (parsed, words):
        lines = tree(plan(out))
        deal = max(i for i, line in enumerate(lines) if "Exchange" in line)
        assert not [line for line in lines[deal:] if "Filter" in line.split("[")[0].split("(")[0]], lines
    assert parsed.count() == 300 and words.count() == 600


def test_documents_of_parts_are_made_in_many_tasks(spark, tmp_path, monkeypatch):
    from dictgraph.plans.sizing import spread_rows
    from dictgraph.registry import published as P

    part = "id AS p_partkey, 'a b' AS p_name, 'T' AS p_type, 'B' AS p_brand, 1 AS p_size"
    spark.range(300).selectExpr(*part.split(", ")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(P, "spread_rows", lambda df: spread_rows(df, 30), raising=False)
    terms = P.bilingual_terms(spark, str(tmp_path))
    assert terms.rdd.getNumPartitions() == 10 and terms.count() == 300 and widest(terms) < 150
