"""O4/O4b/O4c/O6 — mirrors /enum/check plus duplicates, outbound and
validation modes."""

import pytest

from dictgraph import check_membership, membership_pairs, resolve_then_check, validate_column
from tests.fixtures import req, rows


def _check(spark, iso, terms, roots, **kw):
    t = req(spark, list(enumerate(terms)), "pos int, gid string")
    r = req(spark, list(enumerate(roots)), "pos int, gid string")
    return {x.gid: list(x.roots) for x in check_membership(t, r, iso["edges"], **kw).collect()}


def test_multi_root_membership(spark, iso):
    out = _check(spark, iso, ["ISO_639_3_eng", "ISO_639_3_ita"], ["ISO_639_3", "ISO_639_1"])
    assert out == {"ISO_639_3_eng": ["ISO_639_3", "ISO_639_1"], "ISO_639_3_ita": ["ISO_639_3", "ISO_639_1"]}


def test_unknown_term_gets_empty_list(spark, iso):
    assert _check(spark, iso, ["__not_a_real_term_xyz"], ["ISO_639_3"]) == {"__not_a_real_term_xyz": []}


def test_alias_is_literally_not_member(spark, iso):
    assert _check(spark, iso, ["ISO_639_1_en"], ["ISO_639_1"]) == {"ISO_639_1_en": []}


def test_duplicates_repeat_per_occurrence(spark, iso):
    terms, roots = ["ISO_639_3_eng", "ISO_639_3_epo", "ISO_639_3_eng"], ["ISO_639_1", "ISO_639_3", "ISO_639_1"]
    out = _check(spark, iso, terms, roots, repeat_duplicates=True)
    assert out["ISO_639_3_eng"] == ["ISO_639_1", "ISO_639_3", "ISO_639_1"] * 2
    assert out["ISO_639_3_epo"] == ["ISO_639_3"]
    t = req(spark, list(enumerate(terms)), "pos int, gid string")
    r = req(spark, list(enumerate(roots)), "pos int, gid string")
    compact = {x.gid: (list(x.roots), x.occurrences, x.pos) for x in check_membership(t, r, iso["edges"]).collect()}
    assert compact["ISO_639_3_eng"] == (["ISO_639_1", "ISO_639_3", "ISO_639_1"], 2, 0)


def test_outbound_uses_to_end(spark, iso):
    out = _check(spark, iso, ["ISO_639_type_L", "ISO_639_3_eng"], ["ISO_639_3"], direction="outbound")
    assert out == {"ISO_639_type_L": ["ISO_639_3"], "ISO_639_3_eng": []}


def test_empty_lists_are_rejected(spark, iso):
    with pytest.raises(ValueError):
        _check(spark, iso, [], ["ISO_639_3"])
    with pytest.raises(ValueError):
        _check(spark, iso, ["x"], ["ISO_639_3"], direction="sideways")


def test_pairs(spark, iso):
    t = req(spark, [(0, "ISO_639_3_eng"), (1, "ISO_639_3_epo"), (2, "nope")], "pos int, gid string")
    r = req(spark, [(0, "ISO_639_3"), (1, "ISO_639_1")], "pos int, gid string")
    assert rows(membership_pairs(t, r, iso["edges"]), "term", "root") == [
        ("ISO_639_3_eng", "ISO_639_1"), ("ISO_639_3_eng", "ISO_639_3"), ("ISO_639_3_epo", "ISO_639_3"),
    ]


def test_validate_modes(spark, iso):
    fact = req(spark, [(1, "ISO_639_3_eng"), (2, "ISO_639_1_en"), (3, None), (4, "ISO_639_3_epo")], "id int, code string")
    flag = validate_column(fact, "code", "ISO_639_1", iso["edges"])
    assert rows(flag, "id", "is_valid") == [(1, True), (2, False), (3, False), (4, False)]
    assert rows(validate_column(fact, "code", "ISO_639_1", iso["edges"], mode="valid"), "id") == [(1,)]
    assert rows(validate_column(fact, "code", "ISO_639_1", iso["edges"], mode="invalid"), "id") == [(2,), (3,), (4,)]
    # no broadcast: the shuffle-join path gives the same answer
    flag2 = validate_column(fact, "code", "ISO_639_1", iso["edges"], max_broadcast_rows=0)
    assert rows(flag2, "id", "is_valid") == rows(flag, "id", "is_valid")
    # member set over the bound: per-distinct-code decision path
    for mode in ("flag", "valid", "invalid"):
        small = validate_column(fact, "code", "ISO_639_1", iso["edges"], mode=mode, max_broadcast_rows=1)
        full = validate_column(fact, "code", "ISO_639_1", iso["edges"], mode=mode)
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, full.collect()))


def test_resolve_then_check(spark, iso):
    fact = req(spark, [(1, "ISO_639_1_en"), (2, "ISO_639_3_ita"), (3, "_number"), (4, "ISO_639_1_en")], "id int, code string")
    out = resolve_then_check(fact, "code", "ISO_639_1", iso["terms"], iso["edges"])
    assert rows(out, "id", "resolved_gid", "is_valid") == [
        (1, "ISO_639_3_eng", True), (2, "ISO_639_3_ita", True), (3, None, False), (4, "ISO_639_3_eng", True),
    ]
