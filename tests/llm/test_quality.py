"""Word statistics against a plain version; robust estimates against a numpy
version that holds each group in memory."""

import random
import re

import numpy as np
import pytest

from dictgraph.llm import quality as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(hit),
    )


TEXTS = [
    None,
    "",
    " \n\t\x0b\x0c\r",
    "a",
    "a a a a",
    "x y z x y z w",
    "é ñ\x1c\x85 日本 🙂\n\nsame line\nsame line\n same line\n<<||>>",
    "one two three " * 200,
    "\n".join(["the end", "", "the end", " ", " "]),
]


@pytest.mark.parametrize("text", TEXTS)
def test_statistics(text):
    assert Q.statistics(text or "")[:5] == brute(text)


def test_random_statistics():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab é\n#|\t") for _ in range(rng.randrange(60)))
        assert Q.statistics(text)[:5] == brute(text)


def test_chi_squared_cuts():
    # published upper quantiles of 6 degrees of freedom
    assert abs(Q.chi2_cut(0.95, 6) - 12.592) < 1e-3 and abs(Q.chi2_cut(0.999, 6) - 22.458) < 1e-3


def feature_rows(texts):
    names = [f[1] for f in Q.FEATURES]
    return np.array([[eval(sql, {"ln": np.log, "sqrt": np.sqrt, **dict(zip(Q.STATISTICS, Q.statistics(t)))}) for sql in names] for t in texts])


FLOOR = np.diag([f[2] ** 2 for f in Q.FEATURES])


def moments(y, scale=1.0):
    return y.mean(0), np.cov(y.T, bias=True) * scale + FLOOR


def distances(x, m, c):
    return np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)


def numpy_mcd(x, starts=300):
    """The least determinant over many random starts, each concentrated until it
    stands still; none of the engine's own starts."""
    rng = np.random.default_rng(0)
    half = int(np.ceil(Q.SUBSET * len(x)))
    best = None
    for _ in range(starts):
        m, c = moments(x[rng.choice(len(x), Q.P + 1, replace=False)])
        before = np.inf
        while True:
            m, c = moments(x[np.argsort(distances(x, m, c), kind="stable")[:half]])
            now = np.linalg.slogdet(c)[1]
            if now >= before - 1e-9:
                break
            before = now
        if best is None or now < best[0]:
            best = now, m, c
    return best


def numpy_reweighted(x):
    """Means, covariance and cut of the last estimate, from ``numpy_mcd``."""
    _, m, c = numpy_mcd(x)
    d = distances(x, m, c) / (Q.SUBSET / Q.chi2_cdf(Q.chi2_cut(Q.SUBSET, Q.P), Q.P + 2))
    unit = max(1.0, np.sort(d)[int(np.ceil(0.5 * len(x))) - 1] / Q.chi2_cut(0.5, Q.P))
    inner = x[d <= Q.chi2_cut(Q.REWEIGHT, Q.P) * unit]
    scale = Q.REWEIGHT / Q.chi2_cdf(Q.chi2_cut(Q.REWEIGHT, Q.P), Q.P + 2)
    return *moments(inner, scale), Q.outlier_cut(len(inner), Q.REJECT)


def prose(rng, n, junk=False):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n)]
    if junk:
        words = [w + rng.choice(["$$$", "&&&", "***"]) for w in words]
    return "".join(w + ("\n" if rng.random() < 0.1 else " ") for w in words)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(60, 200), junk=i % 10 == 0), "en", "hot", 0) for i in range(300)]
    rows += [(1000 + i, prose(rng, 80, junk=i == 0), "fr", f"s{i % 30}", 0) for i in range(120)]
    rows += [(2000, None, "en", "hot", 0), (2001, "", None, None, 0), (None, prose(rng, 90), None, "hot", 0)]
    rows += [(2003, prose(rng, 70), "de", None, 0)] * 3 + [(2004, "few words", "en", "hot", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int").repartition(4)


def test_verdicts_equal_the_numpy_version(docs):
    rows = Q.quality_rules(docs, min_rows=100).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows if r.base_failed} == {2000, 2001, 2004}
    assert {r.doc_id for r in rows if not r.kept and not r.base_failed} == {*range(0, 300, 10), 1000}
    texts = [r for r in docs.collect() if r.source == "hot" and r.lang == "en" and r.text and len(r.text) > 20]
    x = feature_rows([r.text for r in texts])
    m, c, cut = numpy_reweighted(x)
    want = {r.doc_id: d for r, d in zip(texts, distances(x, m, c))}
    got = {r.doc_id: r.distance2 for r in rows}
    assert all(abs(r.cut2 - cut) < 0.1 for r in rows if r.doc_id in want)
    # the quantile is a summary's, so the subsets may differ by a row
    assert np.allclose([got[i] for i in want], [want[i] for i in want], rtol=0.05, atol=0.2)


@pytest.mark.parametrize("n,junk", [(30, 9), (60, 0), (90, 40), (200, 90)])
def test_the_least_determinant_is_found(spark, n, junk):
    """Against hundreds of random starts, on groups small and contaminated."""
    rng = random.Random(n)
    texts = [prose(rng, rng.randrange(60, 200), junk=i < junk) for i in range(n)]
    least, m, c = numpy_mcd(feature_rows(texts))
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    stats = Q.with_statistics(docs).select("lang", "source", "_q.*")
    fitted = Q.fit_outliers(stats, min_rows=20).collect()
    x = feature_rows(texts)
    mean, cov, _ = numpy_reweighted(x)
    assert len(fitted) == 1 and np.allclose([fitted[0][f"m{i}"] for i in range(Q.P)], mean, atol=0.02)
    inverse = np.linalg.inv(cov)
    assert np.allclose([fitted[0][f"a{i}_{j}"] for i in range(Q.P) for j in range(i, Q.P)], [inverse[i, j] for i in range(Q.P) for j in range(i, Q.P)], rtol=0.1, atol=2)
    assert {i for i, d in enumerate(distances(x, mean, cov)) if d > fitted[0]["cut"]} == set(range(junk))


def test_small_groups_have_their_own_estimate(spark):
    """199 rows of one group, 49 of them symbol junk, and groups of 60."""
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(60, 200), junk=i < 49), "en", "a") for i in range(199)]
    rows += [(1000 * k + i, prose(rng, rng.randrange(60, 200), junk=i < 6), "de", f"s{k}") for k in range(1, 4) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    junk = {*range(49), *(1000 * k + i for k in range(1, 4) for i in range(6))}
    out = Q.quality_rules(docs).collect()
    assert {r.doc_id for r in out if not r.kept} == junk and all(r.distance2 is not None for r in out)
    fitted = Q.fit_outliers(Q.with_statistics(docs).select("lang", "source", "_q.*")).collect()
    assert len({r.g for r in fitted}) == 4  # none is pooled


def test_cuts_for_few_and_for_many_rows():
    assert abs(Q.outlier_cut(10**7, 1e-6) - Q.chi2_cut(1 - 1e-6, 6)) < 1e-3
    assert Q.outlier_cut(60, 1e-6) > 55 and Q.outlier_cut(6, 1e-6) == float("inf")
    rng = np.random.default_rng(1)  # of normal rows under estimates from 40 others a share of 0.05 lies beyond
    beyond = []
    for _ in range(3000):
        m, c = (y := rng.normal(size=(40, 6))).mean(0), np.cov(y.T)
        beyond.append(distances(rng.normal(size=(20, 6)), m, c) > Q.outlier_cut(40, 0.05))
    assert abs(np.mean(beyond) - 0.05) < 0.004


def test_small_tables_use_base_rules_only(docs):
    few = docs.where("doc_id >= 2000")
    assert {(r.doc_id, r.kept) for r in Q.quality_rules(few).collect()} == {(2000, False), (2001, False), (2003, True), (2004, False)}
    assert Q.quality_rules(docs.limit(0)).collect() == []


def test_filter_keeps_the_kept_rows_as_they_are(docs):
    kept = {r.doc_id for r in Q.quality_rules(docs, min_rows=100).collect() if r.kept}
    out = Q.keep_quality(docs, min_rows=100)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == kept


def test_query_statistics_on_the_given_table(spark):
    from dictgraph.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_quality_rules"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, dup, repeat = want = brute(docs[r.doc_id])[:5] if len(docs[r.doc_id]) < 4000 else Q.statistics(docs[r.doc_id])[:5]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.kept and r.base_failed)


@pytest.mark.parametrize("every", [3, 5])
def test_one_kind_of_junk_in_a_third_of_a_group_and_more(spark, every):
    rng = random.Random(5)
    junk = {i for i in range(400) if (i % 3 == 0 if every == 3 else i % 5 < 2)}
    rows = [(i, prose(rng, rng.randrange(60, 200), junk=i in junk), "en", "hot") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    assert {r.doc_id for r in Q.quality_rules(docs).collect() if not r.kept} == junk
