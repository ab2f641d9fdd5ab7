"""O7 — mirrors /fields plus nesting, precedence and truthiness gaps."""

from dictgraph import descriptor_fields
from dictgraph.functions.constants import ENUM_OF
from tests.fixtures import _doc, make_edges, make_terms, req, rows


def _fields(spark, d, gids):
    out = descriptor_fields(req(spark, [(g,) for g in gids], "gid string"), d["terms"], d["edges"])
    res = {}
    for r in out.orderBy("gid", "ord").collect():
        res.setdefault(r.gid, {"status": r.status, "fields": []})
        if r.field_gid is not None:
            res[r.gid]["fields"].append((r.field_gid, r.required))
    return res


def test_original_suite_cases(spark, iso):
    out = _fields(spark, iso, ["_code", "_lid", "__not_a_real_term_xyz"])
    assert out["_code"]["status"] == "ok"
    assert out["_code"]["fields"] == [("_lid", True), ("_gid", True), ("_aid", True)] + [
        (g, False) for g in ["_nid", "_uri", "_pid", "_name", "_symbol", "_symbol_print", "_regexp", "_emoji"]
    ]
    assert out["_lid"] == {"status": "not_object", "fields": []}
    assert out["__not_a_real_term_xyz"] == {"status": "not_found", "fields": []}


def test_gap_cases(spark):
    docs = [
        _doc("nested", _data={"_object": {"_closed": {
            "_required": [
                {"_selection": ["a", ["b", ["c", 7, {"x": "hidden"}, ["d"]], "a"]]},
                "not-an-object",
                {"_selection": "not-an-array"},
                {"_selection": ["e"]},
            ],
            "_recommended": ["c", "f", 3, "a", "g"],
        }}}),
        _doc("both", _data={"_object": {"_open": {"_recommended": ["open"]}, "_closed": {"_recommended": ["closed"]}}}),
        _doc("open_empty", _data={"_object": {"_open": {}, "_closed": {"_recommended": ["closed"]}}}),
        _doc("open_false", _data={"_object": {"_open": False, "_closed": {"_recommended": ["closed"]}}}),
        _doc("empty_object", _data={"_object": {}}),
        _doc("null_object", _data={"_object": None}),
        _doc("zero_object", _data={"_object": 0}),
        _doc("bad", _data={"_object": {"_open": {"_required": {"oops": 1}}}}),
        _doc("shell", info=False),
    ]
    terms = make_terms(spark, docs)
    edges = make_edges(spark, [("nested", ENUM_OF, "shell", ["any"])])
    out = _fields(spark, {"terms": terms, "edges": edges}, [d["_code"]["_gid"] for d in docs])
    assert out["nested"]["fields"] == [
        ("a", True), ("b", True), ("c", True), ("d", True), ("e", True), ("f", False), ("g", False),
    ]
    assert out["both"]["fields"] == [("open", False)]
    assert out["open_empty"] == {"status": "ok", "fields": []}  # {} is truthy: _open wins
    assert out["open_false"]["fields"] == [("closed", False)]
    assert out["empty_object"] == {"status": "ok", "fields": []}
    assert out["null_object"]["status"] == "not_object"
    assert out["zero_object"]["status"] == "not_object"
    assert out["bad"]["status"] == "malformed"
    assert out["shell"]["fields"] == out["nested"]["fields"]  # alias resolved first
