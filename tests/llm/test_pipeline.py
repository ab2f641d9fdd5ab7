"""The pipeline against brute-force versions of its stages."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from dictgraph.llm import pii
from dictgraph.llm.quality import quality_rules
from dictgraph.llm.queries import BYTE_BPE, pii_key
from tests.llm.test_chosen_path import brute as brute_links
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_quality import brute as brute_statistics

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and what every stage makes of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == P.COLUMNS
        assert df.where("n_chars <> char_length(text)").count() == 0


def test_quality(spark, stages):
    """What the base rules leave, by a plain version, without the outliers; their
    distances are held against a numpy version in test_quality.py."""
    before, after = texts(stages[0]), texts(stages[1])
    passed = set()
    for i, t in before.items():
        n, *_, repeat = brute_statistics(t)[:5]
        if n >= 50 and 100 * repeat <= 50 * n:
            passed.add(i)
    rows = {r.doc_id: r for r in quality_rules(stages[0]).collect()}
    near = {i for i in passed if rows[i].distance2 <= rows[i].cut2}
    assert all(rows[i].cut2 > 38 for i in passed)  # every row was judged by an estimate
    assert after == {i: before[i] for i in near}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert good & passed <= near and len(passed - near) < 0.12 * len(passed)


def test_one_of_each_group(stages):
    before, after = texts(stages[1]), texts(stages[2])
    want = {c for _, c, _, _ in brute_links(list(before.items()))}
    assert after == {i: before[i] for i in want}


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    for i, t in before.items():
        n, hit, _ = brute_hits(t, items)
        if hit > 0.8 * n:
            assert i not in after
        elif not hit:
            assert after[i] == t
        else:
            assert brute_hits(after[i], items)[1] == 0 and after[i] != t


def test_pseudonyms(spark, stages):
    before, after = texts(stages[3]), texts(stages[4])
    key = pii_key(spark)
    assert after == {i: pii.pseudonymise(t, key)[0] for i, t in before.items()}
    assert {i: pii.pseudonymise(t, key, -1)[0] for i, t in after.items()} == before


def test_tokens_and_run(spark, stages):
    library = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    before = texts(stages[4])
    got = sorted((r.doc_id, r.ids, r.decoded) for r in stages[5].collect())
    assert got == sorted((i, library.encode(t, add_special_tokens=False).ids, t) for i, t in before.items())
    assert sorted((r.doc_id, r.ids, r.decoded) for r in P.run(spark, SF).collect()) == got


def test_odd_tables(spark):
    rows = [(1, None, None, None, None, "x"), (None, "", "en", "s", 0, "x"), (2, "word " * 3, "en", None, 15, None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        assert len(stage(spark, docs, SF).collect()) <= 6, name
