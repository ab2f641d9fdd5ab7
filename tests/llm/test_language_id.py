"""Code lengths against a byte-by-byte version; held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from dictgraph.llm.language_id import ORDER, Trees, fit_languages, grams, held_out, predict_languages

SF = "/root/testdata/sf0.001"


def brute_bits(trees, counts, lang, data):
    """PPM with escapes over the contexts in the tree, one byte at a time."""
    kept = set(trees.contexts)
    seen = {}
    for code, n in counts[lang].items():
        run = [int(trees.symbol[code >> 8 * k & 0xFF]) for k in range(ORDER, -1, -1)]
        for k in range(ORDER + 1):
            row = seen.setdefault(tuple(run[ORDER - k : ORDER]), {})
            row[run[ORDER]] = row.get(run[ORDER], 0) + n
    history = [int(trees.symbol[0])] * ORDER
    total, size = 0.0, trees.symbols
    for s in (int(trees.symbol[b]) for b in data):
        context = tuple(history[-ORDER:])
        while context not in kept:
            context = context[1:]
        p = 1.0
        while True:
            row = seen.get(context)
            if row is not None:
                n, q = sum(row.values()), len(row)
                if s in row:
                    p *= row[s] / (n + q)
                    break
                p *= q / (n + q)
            if not context:
                p *= 1 / (size + 255) * (max(1, 256 - (size - 1)) / 256 if s == size - 1 else 1)
                break
            context = context[1:]
        total -= math.log2(p)
        history.append(s)
    return total


TRAIN = {
    "aa": "the cat and the hat sat on the mat, and then the cat ran. " * 5,
    "bb": "der Hund und die Katze saßen auf der Matte, und dann lief er weg. " * 5,
}


def counts_of(texts):
    out = {}
    for lang, text in texts.items():
        code, n = grams(text.encode())
        out[lang] = dict(zip(code.tolist(), n.tolist()))
    return out


def test_code_lengths_are_exact(monkeypatch):
    import dictgraph.llm.language_id as L

    counts = counts_of(TRAIN)
    trees = Trees(counts)
    texts = [b"", b"the", "saß der Hund ½ zz".encode(), b"x", b"the mat and the", b"\x00\x00q"]
    data = b"".join(b"\0" * ORDER + t for t in texts)
    starts = np.cumsum([ORDER, *(len(t) + ORDER for t in texts[:-1])])
    want = [[brute_bits(trees, counts, lang, t) for lang in trees.languages] for t in texts]
    for piece in (1 << 20, 7, 4, 1):
        monkeypatch.setattr(L, "PIECE", piece)
        assert np.allclose(trees.code_lengths(data, starts), want, rtol=1e-4)


def test_shares_of_every_context_sum_to_one_at_most():
    trees = Trees(counts_of(TRAIN))
    sums = np.exp2(-trees.bits.astype(float)).reshape(len(trees.contexts), trees.symbols, -1).sum(1)
    assert (sums <= 1 + 1e-4).all()


def test_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.sample(TRAIN[lang].split(), 9)), lang, "clash") for i, lang in enumerate(["aa", "bb"] * 30)]
    odd = [(100, None, "aa", ""), (101, "", "bb", ""), (102, "123 !? ½", None, ""), (None, "the cat sat", None, ""), (0, "der Hund " * 50_000, None, "")]
    docs = spark.createDataFrame(rows + odd + odd[-1:], "doc_id long, text string, lang string, score string").repartition(3)
    trees = fit_languages(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in predict_languages(docs, trees).collect()]
    assert len(got) == len(rows) + 6
    assert {(i, p) for i, p, _ in got if i in (100, 101, 102, None)} == {(100, "und"), (101, "und"), (102, "und"), (None, "aa")}
    assert all(0 <= s <= 1 for _, _, s in got)
    assert [p for i, p, _ in got if i == 0].count("bb") == 2
    assert sum(p == ("aa", "bb")[i % 2] for i, p, _ in got if i is not None and 0 < i < 100) == 59
    assert predict_languages(docs.limit(0), trees).collect() == []
    nothing = fit_languages(docs.limit(0))
    assert {r.lang_pred for r in predict_languages(docs, nothing).collect()} == {"und"}


def test_fold_is_the_crc_of_the_id(spark):
    for r in spark.range(50).select("id", held_out(__import__("pyspark").sql.functions.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0)


def test_held_out_accuracy_on_the_given_table(spark):
    from dictgraph.llm.queries import QUERIES

    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op9_language_id"](spark, SF).collect()]
    assert len(rows) == len(langs)
    out = [r for r in rows if r.held_out]
    assert out and np.mean([langs[r.doc_id] == r.lang_pred for r in out]) >= 0.95


def test_copies_fill_no_sample_and_long_texts_teach_whole(spark):
    """One text of a language comes a thousand times; another language is only
    recognised by the end of a long text."""
    rng = random.Random(3)
    rows = [(0, "zzz copy zzz " * 4, "aa")] * 1000 + [(1 + i, " ".join(rng.sample(TRAIN["aa"].split(), 12)), "aa") for i in range(30)]
    rows += [(100, "0 " * 30_000 + TRAIN["bb"], "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    trees = fit_languages(docs, sample_rows=20)
    asked = spark.createDataFrame([(1, "the hat and the cat"), (2, "der Hund und die Katze")], "doc_id long, text string")
    assert sorted((r.doc_id, r.lang_pred) for r in predict_languages(asked, trees).collect()) == [(1, "aa"), (2, "bb")]


def test_the_model_is_bounded(monkeypatch):
    import dictgraph.llm.language_id as L

    monkeypatch.setattr(L, "MODEL_BYTES", 50_000)
    trees = Trees(counts_of(TRAIN))
    assert trees.bits.nbytes <= 3 * 50_000  # contexts' own beginnings and ends are kept with them
    sums = np.exp2(-trees.bits.astype(float)).reshape(len(trees.contexts), trees.symbols, -1).sum(1)
    assert (sums <= 1 + 1e-4).all()
