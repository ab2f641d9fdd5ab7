"""Gradients by differences, scores token by token, and that training helps."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from dictgraph.llm import masked_lm as M
from dictgraph.llm.decontaminate import words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return M.Vocabulary([(b"the", 50), (b"cat", 20), (b"sat", 10), (b"mat", 3)], [5] * M.BUCKETS)


def test_probabilities_of_all_words_sum_to_one(vocabulary):
    """Over the frequent words and, per bucket, its types and one unseen."""
    scorer = M.Scorer(vocabulary, M.Network.fresh(vocabulary))
    words = [b"the", b"x1", b"cat"]
    by_class = {}
    for word in [b"the", b"cat", b"sat", b"mat"] + [f"zz{i}".encode() for i in range(400)]:
        score = scorer.token_scores([words[0], word, words[2]])[1]
        by_class[vocabulary.id_of(word)] = math.exp(score)
    buckets = [i for i in by_class if i >= vocabulary.n_words]
    assert len(buckets) == M.BUCKETS
    used = set(vocabulary.class_of[: vocabulary.n_words])
    total = sum(by_class[i] for i in range(4)) + sum(by_class[i] * 6 for i in buckets)
    assert total <= 1 + 1e-6 and len(used) <= M.CLASSES


def test_gradients(vocabulary):
    network = M.Network.fresh(vocabulary)
    network.arrays = [a.astype(float) for a in network.arrays]
    rng = np.random.default_rng(1)
    around = rng.integers(0, vocabulary.outside + 1, (6, 2 * M.SIDE))
    classes = rng.integers(0, vocabulary.n_classes, 6)
    _, rows, grads = network.gradients(around, classes)
    vectors = np.zeros_like(network.arrays[0])
    np.add.at(vectors, around.ravel(), rows)
    for a, g in zip(network.arrays, [vectors, *grads]):
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in a.shape)
            kept, e = a[at], 1e-5
            a[at] = kept + e
            up = network.gradients(around, classes)[0]
            a[at] = kept - e
            down = network.gradients(around, classes)[0]
            a[at] = kept
            assert abs((up - down) / (2 * e) - g[at]) < 1e-6


def test_large_weights_stay_finite(vocabulary):
    network = M.Network.fresh(vocabulary)
    network.arrays[3] = network.arrays[3] * 400
    words = b"the cat sat on the mat".split()
    got = M.Scorer(vocabulary, network).token_scores(words)
    assert np.isfinite(got).all() and np.allclose(got, brute_scores(vocabulary, network, words), rtol=1e-4)


def test_a_step_is_adagrad_on_the_summed_gradients(vocabulary):
    """One batch against the same step on dense gradients."""
    rng = np.random.default_rng(5)
    windows = rng.integers(0, vocabulary.outside, (300, 2 * M.SIDE + 1)).astype(np.int16)
    a, b = M.Network.fresh(vocabulary), M.Network.fresh(vocabulary)
    a.train(windows, vocabulary.class_of, 1)
    around = windows[:, [M.SIDE + k for k in M._OFFSETS]].astype(int)
    _, rows, grads = b.gradients(around, vocabulary.class_of[windows[:, M.SIDE].astype(int)])
    vectors = np.zeros_like(b.arrays[0])
    np.add.at(vectors, around.ravel(), rows)
    for x, y, g in zip(a.arrays, b.arrays, [vectors, *grads]):
        assert np.allclose(x, y - M.RATE * g / np.sqrt(1e-6 + g * g), atol=2e-3)


def brute_scores(vocabulary, network, words):
    vectors, w1, b1, w2, b2 = [a.astype(float) for a in network.arrays]
    ids = [vocabulary.id_of(w) for w in words]
    out = []
    for i in range(len(ids)):
        x = []
        for k in (-2, -1, 1, 2):
            j = i + k
            x.extend(vectors[ids[j] if 0 <= j < len(ids) else vocabulary.outside])
        z = np.tanh(np.array(x) @ w1 + b1) @ w2 + b2
        p = np.exp(z) / np.exp(z).sum()
        out.append(math.log(p[vocabulary.class_of[ids[i]]]) + vocabulary.log_share[ids[i]])
    return out


@pytest.mark.parametrize("piece", [1 << 13, 3])
def test_scores_equal_the_plain_version(vocabulary, monkeypatch, piece):
    monkeypatch.setattr(M, "PIECE", piece)
    network = M.Network.fresh(vocabulary)
    words = b"the cat sat on the mat and other things the end".split()
    assert np.allclose(M.Scorer(vocabulary, network).token_scores(words), brute_scores(vocabulary, network, words), atol=1e-5)


def test_every_token_is_trained_on_once_a_pass(vocabulary):
    import pyarrow as pa

    class Held:
        value = vocabulary

    texts = ["the cat sat on the mat " * k for k in range(12)] + [None, "", "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    (out,) = M._encoded(Held, [batch])
    ids = M._on_end(out.column(1))
    got = [w for part in range(M.PARTS) for w in M.windows_of(ids, vocabulary.outside, part).tolist()]
    want = []
    for t in texts:
        own = vocabulary.encode(words_of((t or "").encode()), M.Memo(vocabulary.id_of)).tolist()
        want += [own[i : i + 5] for i in range(len(own) - 4)]
    assert sorted(got) == sorted(want) and len(got) == sum(len((t or "").split()) for t in texts)
    assert len(M.windows_of(ids[:3], vocabulary.outside, 0)) == 0


def test_scores_of_texts_on_end(vocabulary):
    """One sum and least score for each text, whatever stands beside it."""
    import pyarrow as pa

    class Held:
        value = vocabulary

    class Model:
        value = (vocabulary, M.Network.fresh(vocabulary))

    texts = ["the cat", None, "sat on the mat the end", "", "x", "the " * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    (out,) = M._score("doc", Model, M._encoded(Held, [batch]))
    for r, t in zip(out.to_pylist(), texts):
        scores = brute_scores(*Model.value, (t or "").encode().split())
        assert r["n_tokens"] == len(scores) and r["log_likelihood"] == pytest.approx(sum(scores), abs=1e-4)
        assert (r["least_token"] is None) if not scores else r["least_token"] == pytest.approx(min(scores), abs=1e-5)


def chain(rng, n):
    """Words that follow one another in a fixed circle, with some noise."""
    out, at = [], rng.randrange(40)
    for _ in range(n):
        out.append(f"w{at}")
        at = (at + 1) % 40 if rng.random() < 0.95 else rng.randrange(40)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(chain(rng, 300)), 0.0) for i in range(60)]
    mixed = chain(rng, 300)
    rng.shuffle(mixed)
    rows += [(100, " ".join(mixed), 0.0), (101, None, 0.0), (102, "", None), (None, "w1 w2", 0.0), (103, "w1 " * 90_000, 0.0), (0, "w3", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens double").repartition(3)


def test_counts_cover_all_texts(docs):
    want = Counter(w for r in docs.collect() for w in words_of((r.text or "").encode()))
    v = M.fit_vocabulary(docs.select("text"), 10)
    assert list(v.ids) == [w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:10]]
    rest = Counter(M.bucket_of(w) for w in want if w not in v.ids)
    assert np.allclose(v.log_share[10:], [-math.log(rest[b] + 1) for b in range(M.BUCKETS)])


def test_order_of_words_is_learned(docs):
    rows = M.pseudo_likelihood(docs, passes=1).collect()
    assert len(rows) == docs.count()
    by = {(r.doc_id, r.n_tokens): r for r in rows}
    assert by[(101, 0)].log_likelihood == 0 and by[(102, 0)].mean_log_likelihood is None
    clean = [r.mean_log_likelihood for r in rows if r.doc_id is not None and r.doc_id < 60 and r.n_tokens == 300]
    assert len(clean) == 60 and min(clean) > by[(100, 300)].mean_log_likelihood
    assert by[(103, 90_000)].log_likelihood < 0 and (None, 2) in by
    assert M.pseudo_likelihood(docs.limit(0)).collect() == []


def test_query_beats_single_word_shares(spark):
    from dictgraph.llm.queries import QUERIES

    docs = {r.doc_id: words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_masked_lm"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(w) for i, w in docs.items()}
    assert all(r.log_likelihood <= 0 and math.isfinite(r.log_likelihood) for r in rows)
