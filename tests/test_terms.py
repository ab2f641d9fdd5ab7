"""O1/O2 — mirrors the /term cases plus the gaps (JSON-null _info, shell
without edge, dangling canonical, duplicates)."""

from dictgraph import lookup_terms, resolve_alias
from dictgraph.functions.constants import ENUM_OF
from tests.fixtures import _doc, make_edges, make_terms, req, rows


def test_known_term(spark, iso):
    out = resolve_alias(req(spark, [("_code",)], "gid string"), iso["terms"], iso["edges"])
    r = out.collect()[0]
    assert (r.resolved_gid, r.status) == ("_code", "ok")
    assert r.doc is not None


def test_alias_resolves_to_canonical(spark, iso):
    out = resolve_alias(req(spark, [("ISO_639_1_en",)], "gid string"), iso["terms"], iso["edges"])
    r = out.selectExpr("resolved_gid", "status", "try_variant_get(doc, '$._info', 'variant') IS NOT NULL AS has_info").collect()[0]
    assert (r.resolved_gid, r.status, r.has_info) == ("ISO_639_3_eng", "ok", True)


def test_unknown_is_not_found(spark, iso):
    out = resolve_alias(req(spark, [("__not_a_real_term_xyz",)], "gid string"), iso["terms"], iso["edges"])
    assert rows(out, "resolved_gid", "status") == [(None, "not_found")]


def test_bulk_omits_unknown_and_keeps_order(spark, iso):
    r = req(spark, [(0, "_code"), (1, "__not_a_real_term_xyz"), (2, "_info")], "pos int, gid string")
    out = lookup_terms(r, iso["terms"], iso["edges"], ordered=True)
    assert [x.resolved_gid for x in out.collect()] == ["_code", "_info"]


def test_bulk_resolves_aliases(spark, iso):
    r = req(spark, [(0, "ISO_639_1_en"), (1, "ISO_639_1_aa")], "pos int, gid string")
    out = lookup_terms(r, iso["terms"], iso["edges"], ordered=True)
    assert [x.resolved_gid for x in out.collect()] == ["ISO_639_3_eng", "ISO_639_3_aar"]


def test_bulk_duplicates_and_empty(spark, iso):
    r = req(spark, [(0, "ISO_639_1_en"), (1, "ISO_639_3_eng"), (2, "ISO_639_1_en")], "pos int, gid string")
    out = lookup_terms(r, iso["terms"], iso["edges"], ordered=True)
    assert [(x.pos, x.resolved_gid) for x in out.collect()] == [(0, "ISO_639_3_eng"), (1, "ISO_639_3_eng"), (2, "ISO_639_3_eng")]
    empty = lookup_terms(req(spark, [], "pos int, gid string"), iso["terms"], iso["edges"])
    assert empty.count() == 0


def test_gap_cases(spark):
    terms = make_terms(
        spark,
        [
            _doc("null_info", info=False, _info=None),
            _doc("shell_no_edge", info=False),
            _doc("shell_dangling", info=False),
            _doc("shell_two", info=False),
            _doc("canon_a"),
            _doc("canon_b"),
            _doc("data_only", info=False, _data={}),
        ],
    )
    edges = make_edges(
        spark,
        [
            ("ghost", ENUM_OF, "shell_dangling", ["x"]),
            ("canon_b", ENUM_OF, "shell_two", ["x"]),
            ("canon_a", ENUM_OF, "shell_two", ["y"]),
            ("canon_b", "_predicate_bridge-of", "null_info", ["x"]),
        ],
    )
    r = req(spark, [(g,) for g in ["null_info", "shell_no_edge", "shell_dangling", "shell_two", "data_only"]], "gid string")
    out = resolve_alias(r, terms, edges, with_doc=False)
    assert rows(out, "gid", "resolved_gid", "status") == [
        ("data_only", "data_only", "ok"),
        ("null_info", "null_info", "ok"),  # present-with-null counts as present
        ("shell_dangling", None, "not_found"),  # canonical has no document
        ("shell_no_edge", None, "not_found"),
        ("shell_two", "canon_a", "ok"),  # smallest _from, any graph
    ]


def test_small_requests_read_only_their_keys(spark, tmp_path):
    """One requested key is pushed into the scans; documents are read for it alone."""
    from dictgraph.operators.terms import resolve_keys
    from dictgraph.sources.dictionary import terms_from_json

    docs = spark.range(500).selectExpr("concat('k', id) AS _key", "concat('{\"_info\":{\"n\":', id, '}}') AS doc")
    terms_from_json(docs).write.parquet(str(tmp_path / "t"))
    terms = spark.read.parquet(str(tmp_path / "t"))
    edges = make_edges(spark, [("k1", ENUM_OF, "k2", ["R"])])
    out = resolve_keys(spark.createDataFrame([("k7",)], "gid string"), terms, edges)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "EqualTo(_key,k7)" in plan or "In(_key, [k7])" in plan
    assert [(r.gid, r.status) for r in out.select("gid", "status").collect()] == [("k7", "ok")]
