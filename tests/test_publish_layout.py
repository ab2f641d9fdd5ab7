"""Layout of published tables: ranges that no frequent key fills alone, pages,
languages, base collections."""

import random
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dictgraph import drop_materialized, fetch_blobs, materialize
from dictgraph.operators.search import (
    in_language,
    list_page,
    phrase_search_texts,
    segment_index,
    segment_search,
    term_list_view,
    text_index,
    text_index_frame,
    text_index_languages,
    text_search,
)
from dictgraph.plans.numbering import number_rows
from dictgraph.plans.publish import drop_dictionary, publish_base, publish_dictionary
from tests.fixtures import make_terms, req
from tests.test_plans import plan


def groups(df, column):
    """(file, least, greatest) of ``column`` for every row group of a table."""
    out = []
    for file in df.inputFiles():
        meta = pq.ParquetFile(unquote(urlparse(file).path)).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            s = cols[column].statistics
            out.append((file, s.min, s.max))
    return out


def holding(df, column, value):
    return {f for f, low, high in groups(df, column) if low <= value <= high}


def test_a_common_token_spans_files_and_a_rare_one_lies_in_one(spark):
    rows = spark.range(60_000).select(
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc"),
        F.lit("u").alias("unit"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("rare"), F.col("id").cast("string"))).otherwise(F.lit("the")).alias("token"),
        F.lit(0).alias("pos"),
    )
    materialize(spark, "dgl_hot", lambda: rows, range_by=("token", "doc", "pos"), num_ranges=8)
    try:
        t = spark.table("dgl_hot")
        assert len(holding(t, "token", "the")) >= 4
        assert len(holding(t, "token", "rare3000")) == 1
        sizes = [r["count"] for r in t.groupBy(F.input_file_name()).count().collect()]
        assert max(sizes) < 2 * 60_000 / 8  # no task wrote the common token's rows alone
        assert "In(token" in plan(t.filter(F.col("token").isin("rare3000", "rare6"))) and t.count() == 60_000
    finally:
        drop_materialized(spark, ["dgl_hot"])


def test_hub_edges_span_files(spark):
    from tests.fixtures import make_edges

    edges = make_edges(spark, [(f"v{i}", "_predicate_enum-of", "hub" if i % 3 else f"r{i}", ["R"]) for i in range(3000)])
    publish_dictionary(spark, make_terms(spark, [{"_code": {"_gid": "hub"}}]), edges, "dgh_", num_ranges=6)
    try:
        t = spark.table("dgh_edges_by_root")
        assert len(holding(t, "near", "terms/hub")) >= 3 and len(holding(t, "near", "terms/r9")) == 1
    finally:
        drop_dictionary(spark, "dgh_")


def test_pairs_answer_phrases_as_tokens_do(spark):
    rng = random.Random(6)
    texts = [(f"d{i}", " ".join(rng.choices("a b c dé 7".split(), k=rng.randrange(12)))) for i in range(200)]
    df = spark.createDataFrame(texts + texts[:5] + [("d0", None)], "doc string, text string")
    queries = [(i, " ".join(rng.choices("a b c dé 7 zz".split(), k=rng.randrange(5)))) for i in range(80)]
    q = spark.createDataFrame(queries, "query_id int, text string")
    index, pairs = text_index_frame(df, "doc", "text"), text_index_frame(df, "doc", "text", pairs=True)
    got = {tuple(r) for r in text_search(index, q, "phrase", pairs=pairs).collect()}
    assert got == {tuple(r) for r in text_search(index, q, "phrase").collect()}
    assert got == {tuple(r) for r in phrase_search_texts(df, q, "doc", "text").collect()}
    expected = {(i, d) for i, p in queries if p.split() for d, t in texts if f" {p} " in f" {t} "}
    assert got == expected


def test_a_phrase_of_common_words_makes_few_candidates(spark):
    """Both words are in every text, side by side in one."""
    texts = [(f"d{i}", "of x the y " * 3) for i in range(300)] + [("hit", "x of the y")]
    df = spark.createDataFrame(texts, "doc string, text string")
    index, pairs = text_index_frame(df, "doc", "text"), text_index_frame(df, "doc", "text", pairs=True)
    assert index.filter("token = 'of'").count() > 900 and pairs.filter("token = 'of the'").count() == 1
    q = req(spark, [(1, "of the")], "query_id int, text string")
    assert [r.doc for r in text_search(index, q, "phrase", pairs=pairs).collect()] == ["hit"]


def test_segment_pairs(spark, iso):
    t = iso["terms"]
    q = req(spark, [(1, "ISO_639"), (2, "639_3_eng"), (3, "eng"), (4, "3_639"), (5, "")], "query_id int, text string")
    got = {tuple(r) for r in segment_search(segment_index(t), q, "phrase", pairs=segment_index(t, pairs=True)).collect()}
    assert got == {tuple(r) for r in segment_search(segment_index(t), q, "phrase").collect()} and len(got) > 10


LANGUAGES = [
    {"_code": {"_gid": "m"}, "_info": {"_title": {"ISO_639_3_eng": "gold coin", "ISO_639_3_fra": "pièce d'or"},
                                       "_examples": [{"ISO_639_3_fra": "un sou"}, {"ISO_639_3_eng": "a dime"}], "_provider": ["Mint"]}},
    {"_code": {"_gid": "n"}, "_info": {"_title": {"ISO_639_3_fra": "or gold"}, "_notes": "no map", "_url": "plain"}},
    {"_code": {"_gid": "o"}, "_info": {"_title": None}},
]


def test_languages_in_one_pass(spark):
    t = make_terms(spark, LANGUAGES)
    index = text_index_languages(t)
    for lang in ("ISO_639_3_eng", "ISO_639_3_fra", "ISO_639_3_deu"):
        one = {tuple(r) for r in text_index(t, lang).select("doc", "unit", "token", "pos").collect()}
        assert {tuple(r) for r in in_language(index, lang).select("doc", "unit", "token", "pos").collect()} == one
    q = req(spark, [(1, "gold"), (2, "mint")], "query_id int, text string")
    assert {tuple(r) for r in text_search(in_language(index, "ISO_639_3_fra"), q).collect()} == {(1, "n"), (2, "m")}
    assert {tuple(r) for r in text_search(in_language(index, "ISO_639_3_fra"), req(spark, [(1, "un sou")], "query_id int, text string"), "phrase",
                                          pairs=in_language(text_index_languages(t, pairs=True), "ISO_639_3_fra")).collect()} == {(1, "m")}


def test_a_language_reads_its_partition(spark, iso):
    publish_dictionary(spark, make_terms(spark, LANGUAGES), iso["edges"], "dgg_")
    try:
        t = spark.table("dgg_text_postings")
        assert {f.split("lang=")[1].split("/")[0] for f in t.inputFiles()} == {"any", "ISO_639_3_eng", "ISO_639_3_fra"}
        one = in_language(t, "ISO_639_3_fra")
        text = plan(one)
        assert "PartitionFilters: [lang" in text or "PartitionFilters: [isnotnull(lang" in text or "lang#" in text.split("PartitionFilters")[1][:200]
        assert {r["lang"] for r in t.filter(F.col("lang").isin("ISO_639_3_fra", "any")).select("lang").distinct().collect()} == {"any", "ISO_639_3_fra"}
        assert one.filter("token = 'dime'").count() == 0 and one.filter("token = 'sou'").count() == 1
    finally:
        drop_dictionary(spark, "dgg_")


def test_numbers_follow_the_keys(spark):
    rng = random.Random(8)
    values = [None if x == 0 else f"k{x}" for x in (rng.randrange(400) for _ in range(1000))]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k string, i int").repartition(7)
    rows = sorted((r.row, r.k, r.i) for r in number_rows(df, ("k", "i"), num_ranges=6).collect())
    assert [r[0] for r in rows] == list(range(1000))
    assert [(k, i) for _, k, i in rows] == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert number_rows(df.limit(0), ("k",)).collect() == []


def test_pages_of_the_list_view(spark):
    terms = [{"_code": {"_gid": f"g{i:04d}"}, "_info": {"_title": {"ISO_639_3_eng": f"T{i * 7919 % 500:04d}"} if i % 9 else {}}} for i in range(900)]
    t = make_terms(spark, terms)
    publish_dictionary(spark, t, spark.createDataFrame([], "_key string, _from string, _to string, _predicate string, _path array<string>"), "dgv_", num_ranges=6)
    try:
        for name, order in (("term_list", "gid"), ("term_list_by_title", "title")):
            view = spark.table("dgv_" + name)
            expected = [(r.gid, r.title) for r in term_list_view(t, order).collect()]
            pages = [[(r.gid, r.title) for r in sorted(list_page(view, page=k, size=100).collect(), key=lambda r: r.row)] for k in range(10)]
            assert sum(pages, []) == expected and pages[9] == []
            gid, title = pages[4][-1]
            behind = list_page(view, size=100, after=gid if order == "gid" else (title, gid), order=order)
            assert sorted(r.gid for r in behind.collect()) == sorted(g for g, _ in pages[5])
            low, high = 500, 599
            assert len({f for f, a, b in groups(view, "row") if a <= high and b >= low}) <= 2  # of six files
            assert "Sort" not in plan(list_page(view, page=3)) and "GreaterThanOrEqual(row,150)" in plan(list_page(view, page=3))
        assert list_page(spark.table("dgv_term_list"), after="nope").collect() == []
        with pytest.raises(ValueError):
            list_page(spark.table("dgv_term_list"))
        with pytest.raises(ValueError):
            list_page(spark.table("dgv_term_list"), page=0, size=0)
    finally:
        drop_dictionary(spark, "dgv_")


def test_base_collections_and_key_pruning(spark, iso):
    blobs = spark.range(4000).select(
        F.md5(F.col("id").cast("string")).alias("_key"), *[F.lit("x").alias(c) for c in ("_blob_item", "_blob_type", "_blob_kind")],
        F.col("id").cast("string").alias("_blob_identifier"), F.repeat(F.lit("c"), 50).alias("_blob_content"),
    )
    terms = iso["terms"].select("_key", "doc")
    created = publish_base(spark, terms, iso["edges"], blobs, "dgb_", num_ranges=8)
    assert created == ["dgb_terms", "dgb_edges", "dgb_blobs"] and publish_base(spark, terms, iso["edges"], blobs, "dgb_") == []
    publish_dictionary(spark, spark.table("dgb_terms"), spark.table("dgb_edges"), "dgb_")
    t = spark.table("dgb_blobs")
    keys = sorted(r["_key"] for r in t.select("_key").collect())[1000:1010]
    files = {f for k in keys for f in holding(t, "_key", k)}
    assert len(files) <= 2 and len(t.inputFiles()) == 8  # ten neighbouring keys: the other files' row groups are passed over
    asked = spark.createDataFrame([(k,) for k in keys] + [("nope",)], "key string")
    out = fetch_blobs(asked, t)
    assert "In(_key" in plan(out)
    assert sorted(r.status for r in out.collect()) == ["not_found"] + ["ok"] * 10
    assert spark.table("dgb_terms").count() == terms.count()
    dropped = drop_dictionary(spark, "dgb_", base=True)
    assert dropped[-3:] == ["dgb_blobs", "dgb_edges", "dgb_terms"] and "dgb_membership" in dropped
    assert drop_dictionary(spark, "dgb_", base=True) == []


def test_publishing_takes_each_thing_once(spark, monkeypatch):
    """Documents are parsed once, their texts taken once for both text tables,
    words are exploded without anything made of them before, and the edges do
    not move to the few alias shells."""
    from dictgraph.operators import search
    from dictgraph.plans.graph import alias_map
    from dictgraph.sources.dictionary import prepare_terms, rejected_terms, terms_from_json

    text = spark.createDataFrame(
        [("a", '{"_info":{"_title":{"ISO_639_3_eng":"one two  One"}}}'), ("b", "[1]"), ("c", "{"), ("d", None), (None, "{}"), ("e", '{"_code":{}}')],
        "_key string, doc string",
    ).repartition(2)
    parsed = prepare_terms(terms_from_json(text))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson(") == 1
    assert sorted(r["_key"] for r in parsed.collect()) == ["a", "e"]
    assert sorted(str(r["_key"]) for r in rejected_terms(text).collect()) == ["None", "b", "c", "d"]

    lines = spark.createDataFrame([("a", "one Two,  one"), ("b", "one"), ("c", " "), ("d", None), ("a", "x y")], "doc string, text string")
    for pairs, want in ((True, [("a", "one two", 0), ("a", "two one", 1), ("a", "x y", 0)]),
                        (False, [("a", "one", 0), ("a", "one", 2), ("a", "two", 1), ("a", "x", 0), ("a", "y", 1), ("b", "one", 0)])):
        index = search.text_index_frame(lines, "doc", "text", pairs=pairs)
        assert sorted((r["doc"], r["token"], r["pos"]) for r in index.collect()) == want
        assert "lambda" not in index._jdf.queryExecution().optimizedPlan().toString()

    terms = parsed.checkpoint()
    edges = spark.createDataFrame([("k", "terms/x", "terms/e", "_predicate_enum-of", ["terms/r"]), ("j", "terms/w", "terms/e", "_predicate_enum-of", ["terms/r"])],
                                  "_key string, _from string, _to string, _predicate string, _path array<string>").checkpoint()
    shells = alias_map(terms, edges)
    assert "BroadcastHashJoin" in shells._jdf.queryExecution().executedPlan().toString()
    assert shells.collect() == [("terms/e", "terms/w")]

    taken, values = [], search.text_values_by_language
    monkeypatch.setattr(search, "text_values_by_language", lambda t: taken.append(t) or values(t))
    try:
        publish_dictionary(spark, terms, edges, "dgonce_", num_ranges=2)
        assert len(taken) == 1
        assert sorted(r["token"] for r in spark.table("dgonce_text_pairs").collect()) == ["one two", "two one"]
    finally:
        drop_dictionary(spark, "dgonce_")
