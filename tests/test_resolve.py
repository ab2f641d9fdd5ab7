"""O5 — mirrors /resolve/node plus D2 (both seed kinds), D5 (diamond),
outbound, levels bound and a brute-force property check."""

import random

import pytest

from dictgraph import resolve_in_graph
from dictgraph.functions.constants import BRIDGE_OF, ENUM_OF, SECTION_OF
from tests.fixtures import _doc, make_edges, make_terms, req, rows
from tests.test_expand import PREDS, random_graph

REQ = "request_id long, root string, target string"


def _resolve(spark, d, data, **kw):
    out = resolve_in_graph(req(spark, data, REQ), d["edges"], d["terms"], **kw)
    return {r.request_id: (r.resolved_gid, r.status, r.hops) for r in out.collect()}


def test_original_suite_cases(spark, iso):
    out = _resolve(
        spark,
        iso,
        [
            (1, "ISO_639_1", "ISO_639_1_en"),
            (2, "ISO_639_1", "ISO_639_3_eng"),
            (3, "ISO_639_3", "ISO_639_3_eng"),
            (4, "ISO_639_1", "_number"),
            (5, "ISO_639_1", "__not_a_real_term_xyz"),
        ],
    )
    assert out[1] == ("ISO_639_3_eng", "ok", 1)
    assert out[2] == ("ISO_639_3_eng", "ok", 0)
    assert out[3] == ("ISO_639_3_eng", "ok", 0)
    assert out[4][:2] == (None, "not_in_graph")
    assert out[5][:2] == (None, "not_in_graph")


def test_explicit_direction_and_doc(spark, iso):
    out = resolve_in_graph(req(spark, [(1, "ISO_639_1", "ISO_639_1_en")], REQ), iso["edges"], iso["terms"], direction="inbound")
    r = out.selectExpr("resolved_gid", "try_variant_get(doc, '$._info', 'variant') IS NOT NULL AS has_info").collect()[0]
    assert (r.resolved_gid, r.has_info) == ("ISO_639_3_eng", True)


def test_diamond_and_seed_preference(spark):
    terms = make_terms(spark, [_doc(g) for g in ["start", "c", "u", "both", "z"]])
    edges = make_edges(
        spark,
        [
            ("start", BRIDGE_OF, "R", ["R"]),  # seed: non-functional
            ("c", BRIDGE_OF, "start", ["R"]),
            ("u", BRIDGE_OF, "start", ["R"]),
            ("c", ENUM_OF, "u", ["R"]),
            ("both", SECTION_OF, "R", ["R"]),
            ("both", ENUM_OF, "R", ["R"]),
            ("ghost", ENUM_OF, "z", ["R"]),
            ("z", SECTION_OF, "R", ["R"]),
        ],
    )
    d = {"terms": terms, "edges": edges}
    out = _resolve(spark, d, [(1, "R", "start"), (2, "R", "both"), (3, "R", "z")])
    assert out[1] == ("c", "ok", 2)  # c on another path does not block it
    assert out[2] == ("both", "ok", 0)  # functional seed wins
    assert out[3] == (None, "not_found", 1)  # canonical without a document


def test_levels_bound_and_traverse(spark):
    terms = make_terms(spark, [_doc(g) for g in ["t", "a", "b", "canon"]])
    edges = make_edges(
        spark,
        [("t", SECTION_OF, "R", ["R"]), ("a", SECTION_OF, "t", ["R"]), ("b", SECTION_OF, "a", ["R"]), ("canon", ENUM_OF, "b", ["R"])],
    )
    d = {"terms": terms, "edges": edges}
    assert _resolve(spark, d, [(1, "R", "t")], levels=2)[1][:2] == (None, "unresolved")
    assert _resolve(spark, d, [(1, "R", "t")], levels=3)[1] == ("canon", "ok", 3)
    assert _resolve(spark, d, [(1, "R", "t")], traverse=[])[1][:2] == (None, "not_in_graph")
    with pytest.raises(ValueError):
        _resolve(spark, d, [(1, "R", "t")], levels=101)


def test_far_end_on_the_kept_path(spark):
    """The far end lies on the smallest path to v, but not on another one."""
    terms = make_terms(spark, [_doc(g) for g in "scuv"])
    spec = [
        ("s", SECTION_OF, "R", ["R"]),
        ("c", SECTION_OF, "s", ["R"]),
        ("u", SECTION_OF, "s", ["R"]),
        ("v", SECTION_OF, "c", ["R"]),
        ("v", SECTION_OF, "u", ["R"]),
        ("c", ENUM_OF, "v", ["R"]),
    ]
    d = {"terms": terms, "edges": make_edges(spark, spec)}
    assert _resolve(spark, d, [(1, "R", "s")])[1] == ("c", "ok", 3)
    assert _resolve(spark, d, [(1, "R", "s")], levels=2)[1] == (None, "unresolved", None)
    d["edges"] = make_edges(spark, spec[:4] + spec[5:])
    assert _resolve(spark, d, [(1, "R", "s")])[1] == (None, "unresolved", None)


def test_longer_way_around_the_far_end(spark):
    """Only a longer path avoids the far end; a later hit elsewhere loses."""
    terms = make_terms(spark, [_doc(g) for g in "scuwvxyz"])
    spec = [("s", SECTION_OF, "R", ["R"])]
    spec += [(f, SECTION_OF, t, ["R"]) for f, t in ["cs", "vc", "us", "wu", "vw", "xs", "yx", "zy"]]
    spec += [("c", ENUM_OF, "v", ["R"]), ("a", ENUM_OF, "z", ["R"])]
    d = {"terms": terms, "edges": make_edges(spark, spec)}
    # s, u, w, v, c and s, x, y, z, a both take four hops: the smaller handle
    assert _resolve(spark, d, [(1, "R", "s")])[1] == (None, "not_found", 4)
    d["edges"] = make_edges(spark, spec[:-1])
    assert _resolve(spark, d, [(1, "R", "s")])[1] == ("c", "ok", 4)


def brute_resolve(edges, root, target, levels, direction, pred=ENUM_OF, allowed=(SECTION_OF, BRIDGE_OF, ENUM_OF)):
    """Every path with unique vertices, one after another."""
    usable = [(f, t, p) for _k, f, t, p, path in edges if path and root in path and p in allowed]
    near_far = [((t, f) if direction == "inbound" else (f, t)) + (p,) for f, t, p in usable]
    seeds = [p for near, far, p in near_far if far == target]
    if not seeds:
        return None, "not_in_graph"
    if pred in seeds:
        return target, 0
    paths = [[target]]
    for hop in range(1, levels + 1):
        hits = [far for path in paths for near, far, p in near_far if near == path[-1] and far not in path and p == pred]
        if hits:
            return min(hits), hop
        paths = [path + [far] for path in paths for near, far, p in near_far if near == path[-1] and far not in path and p != pred]
    return None, "unresolved"


def cyclic_graph(rng):
    """Few functional edges among many others, with cycles and diamonds."""
    spec = []
    for root in [f"R{i}" for i in range(12)]:
        for f, t in {tuple(rng.sample(range(9), 2)) for _ in range(16)}:
            spec.append((f"v{f}", rng.choice([SECTION_OF, BRIDGE_OF]), f"v{t}", [root]))
        for f, t in {tuple(rng.sample(range(9), 2)) for _ in range(2)}:
            spec.append((f"v{f}", ENUM_OF, f"v{t}", [root]))
    return spec


@pytest.mark.parametrize("seed", [4, 5, 6, 7, 8, 9])
@pytest.mark.parametrize("direction", ["inbound", "outbound"])
def test_matches_brute_force(spark, seed, direction):
    rng = random.Random(seed)
    spec = random_graph(rng) if seed < 6 else cyclic_graph(rng)
    edges = make_edges(spark, spec)
    erows = [(r["_key"], r["_from"], r["_to"], r["_predicate"], r["_path"]) for r in edges.collect()]
    terms = make_terms(spark, [_doc(f"v{i}") for i in range(9)])
    levels = rng.randint(1, 4) if seed < 6 else rng.randint(3, 6)
    data, expected = [], {}
    rid = 0
    for root in sorted({r for *_, path in spec for r in path or []}):
        for b in range(9):
            rid += 1
            data.append((rid, root, f"v{b}"))
            expected[rid] = brute_resolve(erows, f"terms/{root}", f"terms/v{b}", levels, direction)
    out = _resolve(spark, {"terms": terms, "edges": edges}, data, levels=levels, direction=direction)
    for rid, (ans, how) in expected.items():
        got_gid, status, hops = out[rid]
        if ans is None:
            assert (got_gid, status) == (None, how), rid
        else:
            assert (got_gid, status, hops) == (ans.split("/", 1)[1], "ok", how), rid
