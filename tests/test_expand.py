"""O3 — mirrors the /enum traversal cases plus levels > 1, outbound,
stacked bridges, ties, cycles, dangling ends and a brute-force BFS
property check on random graphs."""

import random

import pytest

from dictgraph import expand_enum
from dictgraph.functions.constants import BRIDGE_OF, ENUM_OF, SECTION_OF
from tests.fixtures import FIELD_OF, make_edges, req, rows

REQ = "request_id long, root string, branch string"


def test_direct_enum_children_of_branch(spark, iso):
    out = expand_enum(req(spark, [(1, "ISO_639_3", "ISO_639_type_C")], REQ), iso["edges"], levels=1)
    assert rows(out, "gid", "predicate", "level", "parent") == [("ISO_639_3_epo", ENUM_OF, 1, "terms/ISO_639_type_C")]


def test_sections_listed_no_bridges(spark, iso):
    out = expand_enum(req(spark, [(1, "ISO_639_3", None)], REQ), iso["edges"])
    assert rows(out, "gid", "predicate", "level") == [
        ("ISO_639_scope_I", SECTION_OF, 1), ("ISO_639_scope_M", SECTION_OF, 1), ("ISO_639_scope_S", SECTION_OF, 1),
    ]


def test_bridge_pass_through(spark, iso):
    out = expand_enum(req(spark, [(1, "ISO_639_1", None)], REQ), iso["edges"], levels=1)
    assert rows(out, "gid", "predicate", "level", "parent") == [
        (g, ENUM_OF, 1, "terms/ISO_639_1") for g in ["ISO_639_3_aar", "ISO_639_3_eng", "ISO_639_3_ita"]
    ]


def test_levels_and_full_shape(spark, iso):
    out = expand_enum(req(spark, [(7, "ISO_639_3", None)], REQ), iso["edges"], iso["terms"], levels=3, shape="full")
    got = rows(out, "gid", "level", "parent")
    assert ("ISO_639_type_L", 2, "terms/ISO_639_scope_I") in got
    assert ("ISO_639_3_eng", 3, "terms/ISO_639_type_L") in got
    assert len(got) == 3 + 2 + 4
    gids = out.selectExpr("try_variant_get(term, '$._code._gid', 'string') AS g").collect()
    assert sorted(r.g for r in gids) == sorted(g for g, _, _ in got)


def test_unknown_root_and_bad_arguments(spark, iso):
    assert expand_enum(req(spark, [(1, "nope", None)], REQ), iso["edges"]).count() == 0
    for kw in ({"levels": 0}, {"levels": 21}, {"direction": "up"}, {"shape": "tiny"}):
        with pytest.raises(ValueError):
            expand_enum(req(spark, [(1, "ISO_639_3", None)], REQ), iso["edges"], **kw)


def test_stacked_bridges_budget(spark):
    edges = make_edges(spark, [("b1", BRIDGE_OF, "R", ["R"]), ("b2", BRIDGE_OF, "b1", ["R"]), ("leaf", ENUM_OF, "b2", ["R"])])
    r = req(spark, [(1, "R", None)], REQ)
    assert expand_enum(r, edges, levels=1).count() == 0
    assert rows(expand_enum(r, edges, levels=2), "gid", "level", "parent", "hops") == [("leaf", 1, "terms/R", 3)]


def test_tie_cycle_dangling_and_noise(spark):
    edges = make_edges(
        spark,
        [
            ("s_b", SECTION_OF, "R", ["R"]),
            ("s_a", SECTION_OF, "R", ["R"]),
            ("item", ENUM_OF, "s_b", ["R"]),
            ("item", ENUM_OF, "s_a", ["R"]),
            ("R", ENUM_OF, "item", ["R"]),  # cycle back to the start
            ("noise", FIELD_OF, "R", ["R"]),
            ("other", ENUM_OF, "R", ["Q"]),
            ("x", ENUM_OF, "s_a", None),
            (None, ENUM_OF, "s_a", ["R"]),
        ],
    )
    out = expand_enum(req(spark, [(1, "R", None)], REQ), edges, levels=3)
    assert rows(out, "gid", "level", "parent") == [("item", 2, "terms/s_a"), ("s_a", 1, "terms/R"), ("s_b", 1, "terms/R")]


def test_outbound(spark, iso):
    out = expand_enum(req(spark, [(1, "ISO_639_3", "ISO_639_3_eng")], REQ), iso["edges"], levels=3, direction="outbound")
    assert rows(out, "gid", "predicate", "level") == [
        ("ISO_639_3", SECTION_OF, 3), ("ISO_639_scope_I", SECTION_OF, 2), ("ISO_639_type_L", ENUM_OF, 1),
    ]


# ---------------------------------------------------------------- property

PREDS = [ENUM_OF, SECTION_OF, BRIDGE_OF, FIELD_OF]


def brute_bfs(edges, root, branch, levels, direction):
    adj = {}
    for key, f, t, p, path in edges:
        if path is None or root not in path or p not in (ENUM_OF, SECTION_OF, BRIDGE_OF):
            continue
        near, far = (t, f) if direction == "inbound" else (f, t)
        adj.setdefault(near, []).append((far, p, key))
    visited = {branch}
    frontier = {branch: (0, branch)}
    out = []
    for hop in range(1, levels + 2):
        cands = {}
        for v, (lvl, anc) in frontier.items():
            for far, p, key in adj.get(v, []):
                if far in visited:
                    continue
                isb = p == BRIDGE_OF
                t = (isb, lvl + (0 if isb else 1), anc, key, anc if isb else far, p)
                if far not in cands or t < cands[far]:
                    cands[far] = t
        if not cands:
            break
        frontier = {}
        for v, (isb, lvl, parent, _key, anchor, p) in cands.items():
            visited.add(v)
            if not isb and lvl <= levels:
                out.append((v.split("/", 1)[1], p, lvl, parent, hop))
            frontier[v] = (lvl, anchor)
    return out


def random_graph(rng, n_vertices=9, n_edges=22):
    vs = [f"v{i}" for i in range(n_vertices)]
    spec = []
    for _ in range(n_edges):
        f, t = rng.sample(vs, 2)
        spec.append((f, rng.choice(PREDS), t, rng.sample(["R1", "R2"], rng.randint(1, 2))))
    return spec


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("direction", ["inbound", "outbound"])
def test_matches_brute_force(spark, seed, direction):
    rng = random.Random(seed)
    spec = random_graph(rng)
    edges = make_edges(spark, spec)
    erows = [(r["_key"], r["_from"], r["_to"], r["_predicate"], r["_path"]) for r in edges.collect()]
    levels = rng.randint(1, 3)
    requests = []
    expected = []
    rid = 0
    for root in ["R1", "R2"]:
        for b in range(9):
            rid += 1
            requests.append((rid, root, f"v{b}"))
            for row in brute_bfs(erows, f"terms/{root}", f"terms/v{b}", levels, direction):
                expected.append((rid,) + row)
    out = expand_enum(req(spark, requests, REQ), edges, levels=levels, direction=direction)
    assert rows(out, "request_id", "gid", "predicate", "level", "parent", "hops") == sorted(expected)


def test_null_missing_documents(spark, iso):
    from dictgraph.functions.constants import ENUM_OF as E
    from tests.fixtures import make_edges as me

    edges = iso["edges"].unionByName(me(spark, [("ghost_leaf", E, "ISO_639_type_C", ["ISO_639_3"]), ("deeper", E, "ghost_leaf", ["ISO_639_3"])]))
    r = req(spark, [(1, "ISO_639_3", "ISO_639_type_C")], REQ)
    keep = rows(expand_enum(r, edges, levels=2), "gid", "parent")
    assert keep == [("ISO_639_3_epo", "terms/ISO_639_type_C"), ("deeper", "terms/ghost_leaf"), ("ghost_leaf", "terms/ISO_639_type_C")]
    nulls = rows(expand_enum(r, edges, iso["terms"], levels=2, null_missing=True).fillna("~"), "gid", "parent")
    assert nulls == [("ISO_639_3_epo", "terms/ISO_639_type_C"), ("~", "terms/ISO_639_type_C"), ("~", "~")]


def test_shared_branches_expand_once(spark, iso):
    r = req(spark, [(1, "ISO_639_1", None), (2, "ISO_639_1", None), (3, "ISO_639_3", "ISO_639_type_C"), (4, "ISO_639_1", "ISO_639_1")], REQ)
    out = rows(expand_enum(r, iso["edges"], levels=1), "request_id", "gid", "parent")
    one = [(g, "terms/ISO_639_1") for g in ["ISO_639_3_aar", "ISO_639_3_eng", "ISO_639_3_ita"]]
    assert out == sorted([(i,) + x for i in (1, 2, 4) for x in one] + [(3, "ISO_639_3_epo", "terms/ISO_639_type_C")])


@pytest.mark.parametrize("others", [1, 10_000])
def test_repeated_request_ids_do_not_depend_on_the_other_requests(spark, others):
    """Two rows of one id ask for different branches; each is answered."""
    edges = make_edges(spark, [("a", ENUM_OF, "x", ["R"]), ("b", ENUM_OF, "y", ["R"]), ("a", ENUM_OF, "y", ["R"])])
    data = [(1, "R", "x"), (1, "R", "y"), (2, "R", "x"), (2, "R", "x")] + [(100 + i, "R", f"z{i}") for i in range(others)]
    out = expand_enum(req(spark, data, "request_id long, root string, branch string"), edges).filter("request_id < 100")
    assert sorted((r.request_id, r.gid, r.parent) for r in out.collect()) == [
        (1, "a", "terms/x"), (1, "a", "terms/y"), (1, "b", "terms/y"), (2, "a", "terms/x"), (2, "a", "terms/x")
    ]


def test_rows_by_pair_are_not_copied_to_requests(spark):
    edges = make_edges(spark, [("a", ENUM_OF, "x", ["R"]), ("b", ENUM_OF, "x", ["R"])])
    data = [(i, "R", "x") for i in range(50)]
    out = expand_enum(req(spark, data, "request_id long, root string, branch string"), edges, by_pair=True)
    assert sorted((r.root, r.branch, r.gid) for r in out.collect()) == [("R", "x", "a"), ("R", "x", "b")]
