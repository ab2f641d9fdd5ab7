"""Byte-balanced contiguous shards against a single running sum in Python."""

import zlib

import pytest

from dictgraph.llm.sharding import shard_by_bytes

SF = "/root/testdata/sf0.001"


def brute(rows, shards):
    sized = sorted(
        ((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows),
        key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1], x[2]),
    )
    total, before, slots, out = sum(s for _, _, s in sized), 0, {}, []
    for i, crc, size in sized:
        shard = min((before + size // 2) * shards // total, shards - 1)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, size, crc, "bytes", shard, slots[shard], None))
        before += size
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_equals_brute_force(spark, shards):
    rows = [(i, "x" * (i * 37 % 101), 5) for i in range(200)]
    rows += [(None, None, 1), (None, "", 1), (7, "again", 1), (500, "é" * 9000, 2)] + [(9, "copy", 3)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(5)
    assert got(shard_by_bytes(docs, shards)) == sorted(brute([r[:2] for r in rows], shards), key=repr)


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert shard_by_bytes(docs.limit(0), 8).collect() == []
    assert len(shard_by_bytes(docs, 8).collect()) == 1


def test_query_is_balanced_contiguous_and_native(spark):
    from dictgraph.llm.queries import QUERIES

    df = QUERIES["op6_byte_shards"](spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(df) == sorted(brute(rows, 8), key=repr)
    sizes = {}
    for r in df.collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len(t.encode()) + 1 for _, t in rows)
    assert "Python" not in df._jdf.queryExecution().toString()
