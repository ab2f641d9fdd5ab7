"""Links and classes against comparing all pairs."""

import random

import numpy as np
import pytest

from dictgraph.llm import chosen_path as C
from dictgraph.llm.decontaminate import words_of

SF = "/root/testdata/sf0.001"


def grams(text):
    w = words_of((text or "").encode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{row: (class, links, copies)} by all pairs; rows are (id, text)."""
    sets = [grams(t) for _, t in rows]
    texts = [words_of((t or "").encode()) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    links, copies = [0] * len(rows), [0] * len(rows)
    for x in range(len(rows)):
        for y in range(x):
            c = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 5 * c >= 4 * (len(sets[x]) + len(sets[y]) - c):
                for k in (x, y):
                    links[k] += 1
                    copies[k] += texts[x] == texts[y]
                top[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        r = root(x)
        ids = least.setdefault(r, [])
        if i is not None:
            ids.append(i)
    return sorted([(i, min(least[root(x)], default=None), links[x], copies[x]) for x, (i, _) in enumerate(rows)], key=repr)


def got(df):
    return sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in df.collect()], key=repr)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    out = []
    for _ in range(60):  # pairs near and around the threshold
        base = [word() for _ in range(rng.randrange(20, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            out.append(" ".join(edited(rng, base, rng.randrange(1 + len(base) // 30))))
    hot = [word() for _ in range(150)]
    out += [" ".join(edited(rng, hot, rng.randrange(4))) for _ in range(120)]  # one large group of near copies
    shared = [word() for _ in range(40)]
    out += [" ".join([word() for _ in range(60)] + shared) for _ in range(150)]  # a common passage
    out += ["Same text, three times over here."] * 40 + ["same TEXT three times over here"] * 3
    out += ["a", "a", "b", "a b c", "one two three four", "", " !!", "日本 é ñ x y"]
    rows = list(enumerate(out)) + [(None, None), (len(out), None), (3, out[0]), (3, out[0])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_links string").repartition(5)


def test_join_equals_all_pairs(docs, rows):
    assert got(C.similarity_join(docs)) == brute(rows)


def test_blocks_and_splits_lose_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    monkeypatch.setattr(C, "BUCKET", 4)
    assert got(C.similarity_join(docs)) == brute(rows)


def test_one_row_of_each_class_stays(docs, rows):
    classes = {}
    for (i, t), (_, c, _, _) in zip(sorted(rows, key=repr), brute(rows)):
        classes.setdefault(c, i)
    out = C.keep_one_of_each(docs)
    kept = sorted([(r.doc_id, r.text) for r in out.collect()], key=repr)
    assert out.columns == docs.columns
    joined = brute(rows)
    with_words = {c for (i, c, links, _) in joined if links}
    alone = [x for x in joined if not x[2]]
    assert len(kept) == len(alone) + len(with_words)
    linked = {i: c for i, c, links, _ in joined if links}
    assert all(linked.get(i, i) == i for i, _ in kept)


def test_empty_table(docs):
    assert C.similarity_join(docs.limit(0)).collect() == []
    assert C.keep_one_of_each(docs.limit(0)).collect() == []


def test_runs_reach_the_recall():
    """Trees simulated on pairs with their own number of agreeing coordinates."""
    runs = C.runs_needed()
    assert C.recall_of(runs) >= C.TARGET_RECALL > C.recall_of(runs - 1)
    rng = np.random.default_rng(1)

    def meets(agree, depth=12):
        """Whether a pair that agrees on these coordinates stays together."""
        todo = [(agree[rng.integers(len(agree))], depth)]
        while todo:
            ok, left = todo.pop()
            if ok and left == 0:
                return True
            if ok:
                todo += [(agree[rng.integers(len(agree))], left - 1) for _ in range(C.FANOUT)]
        return False

    pairs = [rng.random(C.COORDINATES) < 0.8 for _ in range(1500)]
    found = np.mean([any(meets(p) for _ in range(2)) for p in pairs])
    assert abs(found - C.recall_of(2)) < 0.03


def test_planted_pairs_at_the_threshold_are_found(spark):
    """Every pair with a similarity of 0.80 to 0.85, among texts that share words."""
    rng = random.Random(12)
    rows, pairs = [], 0
    while pairs < 400:
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(80, 160))]
        other = edited(rng, base, rng.randrange(1, 5))
        a, b = grams(" ".join(base)), grams(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sum(r.class_id == r.doc_id - 1 for r in C.similarity_join(df).collect() if r.doc_id % 2)
    assert found >= 399


def test_comparisons_of_pages_of_a_template(spark):
    """600 sets about 0.62 alike, below the threshold, among others: what a run
    compares stays about all pairs of the group, since splitting on costs more."""
    rng = random.Random(8)
    shared = [f"t{i}" for i in range(154)]
    texts = [" ".join(shared + [f"x{rng.randrange(10**9)}" for _ in range(44)]) for _ in range(600)]
    a, b = grams(texts[0]), grams(texts[1])
    assert 0.55 < len(a & b) / len(a | b) < 0.7
    texts += [" ".join(f"y{rng.randrange(10**9)}" for _ in range(60)) for _ in range(2400)]
    sets = spark.createDataFrame([(str(i), C.sketch(C.shingles(words_of(t.encode()))).tolist()) for i, t in enumerate(texts)], "key string, sketch array<int>")
    runs = C.runs_needed()
    sizes = {r.leaf: r.n for r in C._leaves(sets, len(texts), runs).collect()}
    assert sum(n * (n - 1) // 2 for n in sizes.values()) < 2 * runs * 600 * 599 / 2


def test_sketches_estimate_similarity():
    rng = random.Random(9)
    a = [f"{rng.random()}".encode() for _ in range(2000)]
    b = a[:1800] + [f"{rng.random()}".encode() for _ in range(200)]
    x, y = C.shingles(a), C.shingles(b)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((C.sketch(x) == C.sketch(y)).mean() - true) < 0.16


def test_query_equals_all_pairs(spark):
    from dictgraph.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op5_chosen_path_join"](spark, SF)) == brute(rows)
