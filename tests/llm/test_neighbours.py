"""Multi-index hashing against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dictgraph.llm import neighbours as N
from dictgraph.llm.queries import op13_multi_index_hashing

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, ids, k=10):
    """Exact neighbours of each id, the same rules in plain Python."""
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in ids:
        own = min(v for i, v in ok if i == q)
        d = sorted((float(np.sqrt(((np.array(v) - own) ** 2).sum())), i) for i, v in ok if i != q)
        out[q] = [(i, x) for x, i in d[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("bits,n", [(64, 500), (64, 3), (17, 900), (40, 5000)])
def test_index_returns_every_code_within_the_radius(bits, n):
    rng = np.random.default_rng(bits + n)
    codes = rng.integers(0, 1 << bits, n, dtype=np.uint64)
    codes[: n // 3] = codes[0]
    index = N.MultiIndex(codes, bits)
    for q in [codes[0], codes[-1], *rng.integers(0, 1 << bits, 5, dtype=np.uint64)]:
        for radius in (0, 1, 3, bits // 4, bits // 2, bits):
            expected = np.flatnonzero(np.bitwise_count(codes ^ q) <= radius)
            got = index.within(q, radius)
            assert sorted(got) == expected.tolist()


def test_recall_ranks_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in rows.collect()]
    got = found(op13_multi_index_hashing(spark, SF))
    expected = brute(data, [i for i, _ in data if i % 100 == 0])
    assert got.keys() == expected.keys() and all(len(v) == 10 for v in got.values())
    vectors = dict(data)
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0]))
        for i, d in near:
            assert d == pytest.approx(float(np.linalg.norm(np.array(vectors[i]) - np.array(vectors[q]))), rel=1e-12)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in got)
    assert hits >= 0.9 * 10 * len(got)


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 32))
    data = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    ids = list(range(0, 6000, 50))
    got = found(N.nearest_neighbours(df, df.where("vec_id % 50 = 0"), query_block=50))  # several blocks
    expected = brute(data, ids)
    assert got.keys() == expected.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in ids) >= 0.9 * 10 * len(ids)


def test_copies_ties_and_far_queries(spark):
    data = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(100 + i, [float(i), -5.0, 100.0]) for i in range(5)]
    df = spark.createDataFrame(data, SCHEMA)
    got = found(N.nearest_neighbours(df, df.where("vec_id in (0, 104)"), k=10))
    assert got[0] == [(i, 0.0) for i in range(1, 11)]
    assert got[104] == [(i, pytest.approx(d)) for i, d in brute(data, [104])[104]]  # widened until ten are found


def test_fewer_candidates_than_asked(spark):
    data = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.5])]
    got = found(N.nearest_neighbours(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(data[:1], SCHEMA)))
    assert [i for i, _ in got[0]] == [1, 2]


def test_unusable_rows_take_no_part(spark):
    bad = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0])]
    good = [(10, [1.0, 1.0]), (11, [1.0, 2.0]), (12, [2.0, 1.0]), (12, [2.0, 1.0])]
    df = spark.createDataFrame(bad + good, SCHEMA)
    got = found(N.nearest_neighbours(df, df))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {10: [11, 12, 12], 11: [10, 12, 12], 12: [10, 11]}
    empty = df.limit(0)
    assert N.nearest_neighbours(empty, empty).collect() == [] and N.nearest_neighbours(df, empty).collect() == []


def test_clashing_columns_and_floats(spark):
    data = [(i, [float(i), 1.0], 7, 8, 9) for i in range(30)]
    df = spark.createDataFrame(data, "vec_id int, embedding array<float>, rank int, score int, query_id int").withColumn("id", F.lit(1))
    got = found(N.nearest_neighbours(df, df.where("vec_id = 3"), k=2))
    assert got == {3: [(2, 1.0), (4, 1.0)]}
