"""Streams that follow a dictionary replaced between micro-batches; edge and blob
lines that are none."""

import json

from dictgraph.sources.dictionary import read_blobs, read_edges, read_rejected_blobs, read_rejected_edges
from dictgraph.streaming import current_table, fetch_blobs_each_batch, resolve_alias_each_batch
from tests.fixtures import make_edges, make_terms
from tests.test_publish_stream import _stream


def replace(spark, name, df):
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.saveAsTable(name)


def drain(stream, run, folder, feed):
    """Start, take the first batch, call each of ``feed`` and take what follows."""
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", folder + "/ck").start()
    try:
        q.processAllAvailable()
        for step in feed:
            step()
            q.processAllAvailable()
    finally:
        q.stop()


def test_alias_resolution_follows_a_replaced_dictionary(spark):
    docs = [{"_code": {"_gid": "x"}, "_info": {}}, {"_code": {"_gid": "y"}, "_info": {}}, {"_code": {"_gid": "alias"}}]
    amap = "shell_h string, canonical_h string"
    replace(spark, "dgc_terms", make_terms(spark, docs))
    replace(spark, "dgc_alias", spark.createDataFrame([("terms/alias", "terms/x")], amap))
    stream, folder = _stream(spark, [(1, "alias"), (2, "z")], "id int, gid string")
    got = []
    run = resolve_alias_each_batch(
        lambda s: (current_table(s, "dgc_terms"), current_table(s, "dgc_alias")),
        lambda df, epoch: got.append(sorted((r.id, r.resolved_gid, r.status) for r in df.collect())),
    )

    def change():
        replace(spark, "dgc_alias", spark.createDataFrame([("terms/alias", "terms/y")], amap))
        replace(spark, "dgc_terms", make_terms(spark, docs + [{"_code": {"_gid": "z"}, "_info": {}}]))
        spark.createDataFrame([(3, "alias"), (4, "z")], "id int, gid string").coalesce(1).write.mode("append").parquet(folder + "/in")

    try:
        drain(stream, run, folder, [change])
    finally:
        for name in ("dgc_terms", "dgc_alias"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert got == [[(1, "x", "ok"), (2, None, "not_found")], [(3, "y", "ok"), (4, "z", "ok")]]


def test_blob_lookup_follows_replaced_blobs(spark):
    schema = "_key string, _blob_item string, _blob_type string, _blob_kind string, _blob_identifier string, _blob_content string"
    replace(spark, "dgc_blobs", spark.createDataFrame([("k", "i", "t", "d", "1", "old")], schema))
    stream, folder = _stream(spark, [("k",), ("blobs/k",)], "key string")
    got = []
    run = fetch_blobs_each_batch(
        lambda s: current_table(s, "dgc_blobs"), lambda df, epoch: got.append(sorted((r.key, r._blob_content, r.status) for r in df.collect()))
    )

    def change():
        replace(spark, "dgc_blobs", spark.createDataFrame([("k", "i", "t", "d", "1", "new")], schema))
        spark.createDataFrame([("k",)], "key string").coalesce(1).write.mode("append").parquet(folder + "/in")

    try:
        drain(stream, run, folder, [change])
    finally:
        spark.sql("DROP TABLE IF EXISTS dgc_blobs")
    assert got == [[("blobs/k", "old", "ok"), ("k", "old", "ok")], [("k", "new", "ok")]]


def test_edge_and_blob_lines_that_are_none(spark, tmp_path):
    good = {"_key": "e", "_from": "terms/a", "_to": "terms/b", "_predicate": "_predicate_enum-of", "_path": ["terms/r"]}
    bare = {"_key": "f", "_from": "terms/a", "_to": "terms/b"}
    bad = ['{"_key":', "[1]", "null", "", "7", json.dumps({"_key": "g", "_from": "terms/a"}), json.dumps(good | {"_path": 5})]
    (tmp_path / "e.jsonl").write_text("\n".join([json.dumps(good), json.dumps(bare), *bad]) + "\n")
    rows = read_edges(spark, str(tmp_path / "e.jsonl"), "jsonl").collect()
    assert sorted((r._key, r._path) for r in rows) == [("e", ["terms/r"]), ("f", None)]
    assert sorted(r.text for r in read_rejected_edges(spark, str(tmp_path / "e.jsonl")).collect()) == sorted(bad)
    lines = [json.dumps({"_key": "k", "_blob_content": "x"}), json.dumps({"_blob_content": "x"}), "{"]
    (tmp_path / "b.jsonl").write_text("\n".join(lines) + "\n")
    assert [r._key for r in read_blobs(spark, str(tmp_path / "b.jsonl"), "jsonl").collect()] == ["k"]
    assert sorted(r.text for r in read_rejected_blobs(spark, str(tmp_path / "b.jsonl")).collect()) == sorted(lines[1:])
    assert make_edges(spark, [("a", "_predicate_enum-of", "b", ["r"])]).columns == rows[0].__fields__
