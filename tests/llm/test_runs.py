"""Grammar-compressed run detection against brute force."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from dictgraph.llm import runs as R
from dictgraph.llm.queries import op12_periodic_runs, with_planted_periods

SF = "/root/testdata/sf0.001"


def brute(words, exponent=4, length=6):
    """Every maximal run, one period after another; a stretch's smallest period counts."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(length, exponent * q):
                best.setdefault((i, j + q), q)  # the smaller period came first
            i = max(j, i) + 1
    return sorted((lo, hi - lo, q) for (lo, hi), q in best.items())


def split(text):
    return (text or "").encode().split()


def planted(doc_id, words):
    """The contract's rewriting in plain Python."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapsed(words, runs):
    drop = {i for lo, n, q in runs for i in range(lo + q, lo + n)}
    return [w for i, w in enumerate(words) if i not in drop]


@pytest.mark.parametrize("seed", range(12))
def test_random_words(seed):
    rng = random.Random(seed)
    for _ in range(60):
        kinds = rng.choice([1, 2, 3, 5])
        words = [rng.randrange(kinds) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):  # plant runs, also next to and inside each other
            q = rng.randrange(1, 8)
            block = [rng.randrange(kinds) for _ in range(q)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (block * 9)[: rng.randrange(3 * q, 8 * q + 1)]
        assert R.grammar_runs(words) == brute(words)


def test_other_exponents_and_lengths():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.randrange(2) for _ in range(rng.randrange(80))]
        assert R.grammar_runs(words, 5, 12) == brute(words, 5, 12)
    with pytest.raises(ValueError):
        R.periodic_runs(None, min_exponent=3)


def test_grammar_gives_the_text_back():
    rng = random.Random(2)
    for _ in range(100):
        words = [rng.randrange(3) for _ in range(rng.randrange(100))]
        last, rules = R.re_pair(words)
        assert [w for s, t in last for w in words[s:t]] == words
        for s, t, b, places in rules:
            assert s < b < t and len(places) > 1
            assert all(words[p : p + t - s] == words[s:t] for p in places)
    last, rules = R.re_pair([1, 2, 3, 4, 5, 6, 7] * 64)
    assert len(last) < 4 and len(rules) < 16  # each repetition becomes a rule


def test_long_repetitive_sequences_stay_fast():
    for words in ([7] * 200_000, [1, 2, 3] * 40_000, list(range(5000)) * 5):
        q = len(set(words))
        assert R.grammar_runs(words) == [(0, len(words), q)]


def test_stretches_lose_no_run():
    import numpy as np

    rng = random.Random(4)
    for _ in range(50):
        texts = []
        for _ in range(5):
            words = [rng.randrange(30) for _ in range(rng.randrange(80))]
            q = rng.randrange(1, 6)
            at = rng.randrange(len(words) + 1)
            words[at:at] = [rng.randrange(30) for _ in range(q)] * 6
            texts.append(words)
        ids = np.array([w for t in texts for w in t])
        number = np.repeat(np.arange(5), [len(t) for t in texts])
        starts = np.cumsum([0] + [len(t) for t in texts])
        got = sorted((s + a, n, p) for s, t in R.repeated_stretches(ids, number) for a, n, p in R.grammar_runs(ids[s:t].tolist()))
        assert got == sorted((int(starts[k]) + a, n, p) for k, t in enumerate(texts) for a, n, p in brute(t))


def test_rows_of_the_table(spark):
    """Short texts against every period, long ones against their planted run."""
    rows = {r.doc_id: r for r in R.periodic_runs(with_planted_periods(spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
    out = {r.doc_id: r for r in op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(out) == len(docs)
    some = 0
    for d in docs:
        words = planted(d.doc_id, split(d.text))
        runs, r, o = brute(words), rows[d.doc_id], out[d.doc_id]
        some += bool(runs)
        assert [tuple(x) for x in r.runs] == sorted(runs, key=lambda x: (x[0], x[2])) and r.n_words == len(words)
        assert r.collapsed.encode() == b" ".join(collapsed(words, runs))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        expected = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (o.n_runs, o.start, o.length, o.period, o.exponent_milli) == (len(runs), *expected)
        assert o.runs_sha256 == sha256("".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda x: (x[0], x[2]))).encode()).hexdigest()
        assert o.collapsed_sha256 == sha256(b" ".join(collapsed(words, runs))).hexdigest()
    assert some > 5


def test_odd_rows(spark):
    long = "x " * 5000 + "a b c " * 300 + "é ü " * 9
    rows = [(1, None, 1), (2, "", 1), (3, " \t\n", 1), (None, "a a a a a a", 1), (4, "a a a a a", 1), (4, "a a a a a", 1), (5, long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("n_words", F.lit("clash"))
    got = sorted(R.periodic_runs(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got[:6]] == [
        (None, [(0, 6, 1)], "a"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [], "a a a a a"), (4, [], "a a a a a")
    ]
    assert [tuple(x) for x in got[6].runs] == brute(split(long)) and got[6].collapsed == "x a b c é ü"
    assert R.periodic_runs(df.limit(0)).collect() == []
    assert with_planted_periods(spark.createDataFrame([(None, "a b"), (3, None)], "doc_id long, text string")).count() == 2


def test_no_shuffle(spark):
    plan = R.periodic_runs(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
