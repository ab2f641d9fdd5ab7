"""Metamorphic and golden checks: inbound on G equals outbound on reversed
G; a batch of requests equals the single requests; golden values of the
derived dictionary (FIXTURES.md) on the driver tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from dictgraph import expand_enum, resolve_in_graph
from dictgraph import registry
from tests.fixtures import _doc, make_edges, make_terms, req, rows
from tests.test_expand import random_graph

EXP = "request_id long, root string, branch string"
RES = "request_id long, root string, target string"


def _reversed(edges):
    return edges.select("_key", F.col("_to").alias("_from"), F.col("_from").alias("_to"), "_predicate", "_path")


@pytest.mark.parametrize("seed", [11, 12])
def test_inbound_equals_outbound_on_reversed_graph(spark, seed):
    rng = random.Random(seed)
    edges = make_edges(spark, random_graph(rng))
    terms = make_terms(spark, [_doc(f"v{i}") for i in range(9)])
    er = [(i, r, f"v{b}") for i, (r, b) in enumerate((r, b) for r in ("R1", "R2") for b in range(9))]
    cols = ("request_id", "gid", "predicate", "level", "parent", "hops")
    a = rows(expand_enum(req(spark, er, EXP), edges, levels=2), *cols)
    b = rows(expand_enum(req(spark, er, EXP), _reversed(edges), levels=2, direction="outbound"), *cols)
    assert a == b
    ra = rows(resolve_in_graph(req(spark, er, RES), edges, terms, levels=3, with_doc=False), "request_id", "resolved_gid", "status", "hops")
    rb = rows(resolve_in_graph(req(spark, er, RES), _reversed(edges), terms, levels=3, direction="outbound", with_doc=False), "request_id", "resolved_gid", "status", "hops")
    assert ra == rb


def test_batch_equals_single_requests(spark):
    rng = random.Random(21)
    edges = make_edges(spark, random_graph(rng))
    er = [(i, "R1", f"v{i}") for i in range(9)]
    cols = ("request_id", "gid", "predicate", "level", "parent", "hops")
    batch = rows(expand_enum(req(spark, er, EXP), edges, levels=3), *cols)
    single = sorted(x for r in er[:4] for x in rows(expand_enum(req(spark, [r], EXP), edges, levels=3), *cols))
    assert [x for x in batch if x[0] < 4] == single


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_golden_values_of_derived_dictionary(spark):
    d = registry.dictionary(spark, SF)
    e = d["edges"]
    assert e.count() == 22250
    assert e.groupBy("_predicate").count().orderBy("_predicate").collect() == [
        ("_predicate_bridge-of", 25), ("_predicate_enum-of", 22154), ("_predicate_field-of", 25), ("_predicate_section-of", 46)
    ]
    t = d["terms"]
    assert (t.count(), t.filter("is_alias").count()) == (2058, 26)
    q = registry.QUERIES
    geo4 = q["expand_geo_l4"](spark, SF)
    by_level = {r.level: (r.n, r.parents) for r in geo4.groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("parent").alias("parents")).collect()}
    assert by_level == {1: (5, 1), 2: (25, 5), 3: (1500, 25), 4: (15000, 1500)}
    part = q["expand_multi_parent_part"](spark, SF).filter(F.col("level") == 2)
    assert part.count() == 2000
    assert part.filter(~F.col("parent").startswith("terms/part_brand_")).count() == 0
    assert part.select("parent").distinct().count() == 25
    out = q["expand_outbound_orders"](spark, SF).filter(F.col("request_id") == 0)
    assert rows(out, "level", "gid", "predicate") == [
        (1, "cust_899", "_predicate_enum-of"), (2, "geo_nation_15", "_predicate_enum-of"),
        (3, "geo_region_0", "_predicate_enum-of"), (4, "geo", "_predicate_section-of"),
    ]
    branch = q["expand_branch_nations"](spark, SF).filter((F.col("request_id") == 3) & (F.col("level") == 1))
    assert branch.count() == 67 and branch.select("parent").distinct().count() == 1
    valid = q["validate_events_valid"](spark, SF).count()
    assert valid == 7986
    nc = {r.target: (r.resolved_gid, r.hops) for r in q["resolve_nation_code"](spark, SF).filter(F.col("target").isin("nation_code_7", "geo_nation_7")).collect()}
    assert nc == {"nation_code_7": ("geo_nation_7", 1), "geo_nation_7": ("geo_nation_7", 0)}
    f = q["descriptor_fields_parts"](spark, SF).filter(F.col("gid") == "part_item_0").orderBy("ord")
    assert [(r.field_gid, r.required) for r in f.collect()][-1] == ("price", False)
    assert f.count() == 4
