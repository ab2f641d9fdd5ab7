"""O10–O14 — the declared search surfaces."""

from pyspark.sql import functions as F

from dictgraph import (
    domain_filter,
    domain_index,
    identifier_index,
    identifier_search,
    segment_index,
    segment_search,
    term_list_view,
    text_index,
    text_search,
)
from dictgraph.operators.search import _answers
from tests.fixtures import _doc, make_terms, req, rows


def _terms(spark):
    return make_terms(
        spark,
        [
            _doc("ISO_3166_1", _domn={"_term_role": ["standard"], "org": {"name": "ISO", "year": 1974}}),
            _doc("ISO_639_3", _domn={"_term_role": ["standard", "language"]}),
            _doc("ISO_3166_2_x", _domn={"_term_role": "standard"}),
            _doc("_code", info=False, _data={}),
            {"_code": {"_gid": "_lid", "_aid": ["lid", "local id"], "_nid": "n1", "_name": "Local"},
             "_info": {"_title": {"ISO_639_3_eng": "Local identifier"},
                       "_definition": {"ISO_639_3_eng": "The code's local part, unique in its namespace."},
                       "_examples": [{"ISO_639_3_eng": "eng for English"}, {"ISO_639_3_ita": "ita"}],
                       "_citation": ["ISO 639-3 registration"]}},
        ],
    )


def test_segment_search(spark):
    t = _terms(spark)
    idx = segment_index(t)
    q = req(spark, [(1, "ISO_3166"), (2, "3166_ISO"), (3, "code"), (4, "639 3"), (5, "1_639")], "query_id int, text string")
    got = rows(segment_search(idx, q.filter("query_id in (1, 3)"), "any"), "query_id", "gid")
    assert got == [(1, "ISO_3166_1"), (1, "ISO_3166_2_x"), (1, "ISO_639_3"), (3, "_code")]
    assert rows(segment_search(idx, q.filter("query_id = 2"), "all"), "gid") == [("ISO_3166_1",), ("ISO_3166_2_x",)]
    assert rows(segment_search(idx, q.filter("query_id = 2"), "phrase"), "gid") == []
    assert rows(segment_search(idx, q.filter("query_id = 1"), "phrase"), "gid") == [("ISO_3166_1",), ("ISO_3166_2_x",)]
    assert rows(segment_search(idx, q.filter("query_id = 5"), "all"), "gid") == []


def test_identifier_search(spark):
    idx = identifier_index(_terms(spark))
    q = req(spark, [(1, "local id", None), (2, "n1", "_nid"), (3, "n1", "_aid"), (4, "ISO_639_3", None)], "query_id int, value string, field string")
    assert rows(identifier_search(idx, q), "query_id", "field", "gid") == [(1, "_aid", "_lid"), (2, "_nid", "_lid")]


def test_identifier_answers_are_not_shuffled(spark):
    index = req(spark, [("_aid", "7", "a"), ("_lid", "7", "a"), ("_aid", "x", "a"), ("_aid", "7", "b")], "field string, value string, gid string")
    one = req(spark, [(1, "7", None), (2, "7", "_aid"), (2, "7", "_aid"), (None, "x", None)], "query_id int, value string, field string")
    out = identifier_search(index, one)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # only the index is made distinct, below the join
    got = {(1, "_aid", "a"), (1, "_lid", "a"), (1, "_aid", "b"), (2, "_aid", "a"), (2, "_aid", "b"), (None, "_aid", "a")}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(got, key=str)
    # several conditions of a query that find one row give it once
    more = one.unionByName(req(spark, [(1, "x", "_aid"), (None, "7", "_lid"), (None, "7", "_aid")], one.schema))
    got |= {(None, "_lid", "a"), (None, "_aid", "b")}
    assert sorted(map(tuple, identifier_search(index, more).collect()), key=str) == sorted(got, key=str)


def test_identifier_answers_are_made_of_blocks(spark, tmp_path):
    # blocks of two: every value, field and id of either side meets, nulls included
    found = [(f, v, g) for f in ("_aid", "_lid") for v in ("7", "8") for g in ("a", "b", "c", "d", "e", None)] + [("_lid", "9", "z")]
    asked = [(k, f, v) for k, f in ((1, None), (2, "_aid"), (3, "_lid"), (4, None), (5, None), (None, "_lid")) for v in ("7", "9", "0")]
    out = _answers(req(spark, found, "field string, value string, gid string"), req(spark, asked, "query_id int, qfield string, value string"), 2)
    want = [(k, f, g) for k, qf, v in asked for f, w, g in found if v == w and qf in (None, f)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    # a value that all hold and all ask: no side is broadcast, tasks share the
    # answers, and these take less than a byte each
    n = 3000
    index = spark.range(n).selectExpr("'_aid' AS field", "'7' AS value", "concat('sup_', id) AS gid")
    out = identifier_search(index, spark.range(n).selectExpr("id * 10 AS query_id", "'7' AS value"))
    out.withColumn("task", F.spark_partition_id()).write.parquet(str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == n * n
    assert written.select("task").distinct().count() > 1
    assert sum(f.stat().st_size for f in (tmp_path / "out").rglob("*.parquet")) < n * n


def test_text_search(spark):
    idx = text_index(_terms(spark))
    q = req(spark, [(1, "local PART"), (2, "unique namespace"), (3, "namespace unique"), (4, "registration"), (5, "ita")], "query_id int, text string")
    assert rows(text_search(idx, q, "all"), "query_id", "doc") == [(1, "_lid"), (2, "_lid"), (3, "_lid"), (4, "_lid")]
    assert rows(text_search(idx, q, "phrase"), "query_id") == [(1,), (4,)]
    assert rows(text_search(idx, q.filter("query_id = 5"), "any"), "doc") == []  # only English is indexed


def test_domain_filter(spark):
    idx = domain_index(_terms(spark))
    assert ("org.name", "ISO", "ISO_3166_1") in rows(idx, "path", "value", "gid")
    assert ("org.year", "1974", "ISO_3166_1") in rows(idx, "path", "value", "gid")
    q = req(spark, [(1, "_term_role", "standard"), (2, "_term_role", "standard"), (2, "_term_role", "language")], "query_id int, path string, value string")
    assert rows(domain_filter(idx, q), "query_id", "gid") == [(1, "ISO_3166_1"), (1, "ISO_3166_2_x"), (1, "ISO_639_3"), (2, "ISO_639_3")]


def test_term_list_view(spark):
    v = term_list_view(_terms(spark))
    got = [(r.gid, r.nid, r.title) for r in v.collect()]
    assert [g for g, _, _ in got] == sorted(g for g, _, _ in got)
    assert ("_lid", "n1", "Local identifier") in got
    by_title = [r.title for r in term_list_view(_terms(spark), order="title").collect()]
    assert by_title[:4] == sorted(t for t in by_title if t is not None)[:4]


def test_token_pushdown_fallback_gives_same_result(spark, monkeypatch):
    import dictgraph.operators.search as S

    idx = segment_index(_terms(spark))
    q = req(spark, [(1, "ISO_3166"), (2, "639_3"), (3, "code")], "query_id int, text string")
    expected = {m: rows(segment_search(idx, q, m), "query_id", "gid") for m in ("any", "all", "phrase")}
    monkeypatch.setattr(S, "MAX_PUSHED_TOKENS", 1)  # force the semi-join path
    for m, exp in expected.items():
        assert rows(segment_search(idx, q, m), "query_id", "gid") == exp


def test_spreading_narrow_text_input_keeps_postings(spark):
    from dictgraph.operators.search import text_index_frame

    docs = req(spark, [(1, "Alpha beta, gamma"), (2, "beta  delta")], "doc_id long, text string").coalesce(1)
    a = rows(text_index_frame(docs, "doc_id", "text", spread=True), "doc", "token", "pos")
    b = rows(text_index_frame(docs, "doc_id", "text", spread=False), "doc", "token", "pos")
    assert a == b == [(1, "alpha", 0), (1, "beta", 1), (1, "gamma", 2), (2, "beta", 0), (2, "delta", 1)]


def test_phrases_stay_within_one_row_of_a_doc(spark):
    from dictgraph.operators.search import phrase_search_texts, text_index_frame, text_search

    rows = [("a", "alpha beta"), ("a", "alpha beta"), ("b", "alpha x"), ("b", "y beta"), ("c", "beta alpha beta"), ("d", None)]
    texts = spark.createDataFrame(rows, "doc string, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "alpha zeta"), (4, "beta alpha beta")], "query_id int, text string")
    index = text_index_frame(texts, "doc", "text")
    want = {(1, "a"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (4, "c")}
    assert {tuple(r) for r in text_search(index, q, "phrase").collect()} == want
    assert {tuple(r) for r in phrase_search_texts(texts, q, "doc", "text").collect()} == want


def test_search_of_given_fields(spark, iso):
    from dictgraph.operators.search import text_index, text_search, text_values

    values = text_values(iso["terms"]).limit(200).collect()
    index = text_index(iso["terms"])
    assert values
    for field in {v.field for v in values}:
        word = next(v.text for v in values if v.field == field).split()[0]
        q = spark.createDataFrame([(1, word)], "query_id int, text string")
        one = {r.doc for r in text_search(text_index(iso["terms"], fields=[field]), q, "all").collect()}
        assert {r.doc for r in text_search(index, q, "all", fields=[field]).collect()} == one


def test_facets_below_any_depth(spark):
    from dictgraph.operators.search import domain_filter, domain_index
    from tests.fixtures import make_terms

    deep = {"leaf": "x"}
    for k in range(66):
        deep = {f"k{k}": deep} if k else {f"k{k}": [deep, {"other": k}]}
    terms = make_terms(spark, [{"_code": {"_gid": "t"}, "_domn": deep}])
    index = domain_index(terms.coalesce(1))
    path = ".".join(f"k{k}" for k in reversed(range(66))) + ".leaf"
    assert index.filter(index.path == path).count() == 1
    q = spark.createDataFrame([(1, path, "x")], "query_id int, path string, value string")
    assert [tuple(r) for r in domain_filter(index, q).collect()] == [(1, "t")]


def test_all_mode_keeps_a_token_once_a_doc(spark, monkeypatch):
    from dictgraph.operators import search as S

    kept, cut = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    postings = req(spark, [("a", f"u{i % 3}", w, i) for i in range(30) for w in ("x", "y")] + [("b", "u", "x", 0)], "doc string, unit string, token string, pos int")
    q = req(spark, [(1, 0, "x"), (1, 1, "y"), (1, 2, "x")], "query_id int, qpos int, token string")
    assert rows(S.match(postings, q, "all"), "query_id", "doc") == [(1, "a")]
    assert [df.count() for df in kept if "doc" in df.columns] == [3]


def test_wanted_stems_are_broadcast_whatever_the_vocabulary(spark, monkeypatch):
    from dictgraph.operators import search as S
    from tests.test_plans import plan, tree

    monkeypatch.setattr(S, "DEFAULT_MAX_BROADCAST_ROWS", 5)
    words = req(spark, [(i, f"word{i}") for i in range(30)] + [(50, "runs"), (51, "running")], "doc int, token string")
    wanted = req(spark, [("run",), ("absent",)], "token string")
    out = S.stemmed(words, wanted=wanted)
    assert rows(out, "doc", "token") == [(50, "run"), (51, "run")]
    assert "BroadcastHashJoin" in "\n".join(tree(plan(out))) and "SortMergeJoin" not in "\n".join(tree(plan(out)))
    assert S.stemmed(words).count() == 32
