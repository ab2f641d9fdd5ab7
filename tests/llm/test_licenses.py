"""Canonical digests: equivalent writings meet, different texts do not."""

import pytest

from dictgraph.llm.license_texts import KNOWN
from dictgraph.llm.licenses import known_licenses, license_scan

SF = "/root/testdata/sf0.001"
MIT = next(t for i, t in KNOWN if i == "MIT")


def scan(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, license_id string")
    return {(r.doc_id, r.license_id, tuple(r.notices)) for r in license_scan(docs.repartition(2), known_licenses(spark)).collect()}


def test_equivalent_writings_match(spark):
    rows = [
        (1, MIT.upper()),
        (2, "Copyright (c) 2024 Someone <a@b.c>\nAll rights reserved.\n\n" + MIT),
        (3, "\n".join(" * " + x for x in MIT.replace("sublicense", "sub-licence").split("\n"))),
        (4, MIT.replace("Software", "Firmware")),
        (5, "// © Someone\n" + MIT.replace('"', "``")),
        (6, MIT + " And more."),
    ]
    assert {x[:2] for x in scan(spark, rows)} == {(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, None), (5, "MIT"), (6, None)}


def test_lines_nulls_repeats(spark):
    rows = [
        (1, None),
        (2, ""),
        (3, "a\nReleased under the MIT licence\nb\n# SPDX-License-Identifier: Apache-2.0\nReleased under the MIT License."),
        (None, "Released under the MIT License."),
        (None, "nothing"),
        (3, "same id"),
        (4, "word " * 50_000 + "\nLicensed under CC BY-NC 4.0."),
    ]
    assert scan(spark, rows) == {
        (1, None, ()),
        (2, None, ()),
        (3, None, ("Apache-2.0", "MIT")),
        (None, "MIT", ("MIT",)),
        (None, None, ()),
        (3, None, ()),
        (4, None, ("CC-BY-NC-4.0",)),
    }


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x")] * 3, "doc_id long, text string")
    assert len(license_scan(docs, known_licenses(spark)).collect()) == 3
    assert license_scan(docs.limit(0), known_licenses(spark)).collect() == []


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from dictgraph.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = QUERIES["op4_license_scan"](spark, SF)
    want = con.execute(ORACLE["op4_license_scan"]).fetchall()
    assert sorted((r.doc_id, r.digest, r.license_id or "", r.notices, r.passages) for r in df.collect()) == sorted((a, b, c or "", d, e) for a, b, c, d, e in want)
    assert "Python" not in df._jdf.queryExecution().toString()


FULL = {
    "Apache-2.0": "Apache-2.0",
    "Artistic": "Artistic-1.0-Perl",
    "CC0-1.0": "CC0-1.0",
    "GPL-2": "GPL-2.0-only",
    "GPL-3": "GPL-3.0-only",
    "LGPL-2.1": "LGPL-2.1-only",
    "LGPL-3": "LGPL-3.0-only",
    "MPL-2.0": "MPL-2.0",
}


def test_whole_published_texts_are_found(spark):
    from dictgraph.llm.license_texts import PUBLISHED

    rows = [(f, PUBLISHED[f]) for f in FULL]
    rows += [("cut", PUBLISHED["GPL-3"].split("END OF TERMS")[0]), ("owner", PUBLISHED["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 A"))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.license_id for r in license_scan(docs, known_licenses(spark)).collect()}
    assert got == {**FULL, "cut": "GPL-3.0-only", "owner": "Apache-2.0"}


def test_wrapped_notices_inside_longer_texts(spark):
    from dictgraph.llm.license_texts import PUBLISHED

    text = PUBLISHED["Apache-2.0"]
    notice = text[text.rindex("Licensed under") :].rstrip()
    comment = "\n".join(" * " + x.strip() for x in notice.split("\n"))
    rows = [
        (1, f"A tool.\n\nCopyright 2020 A\n\n{notice}\n\nUsage: run it."),
        (2, f"/*\n * Copyright 2020 A\n *\n{comment}\n */\n\nimport x\n"),
        (3, notice.split("Unless")[0] + "\n\nAnd more.\n\nUnless" + notice.split("Unless")[1]),
        (4, "Read me\n\n" + MIT + "\n\n" + PUBLISHED["MPL-2.0"]),
        (5, "\n" * 50_000 + "x"),
        (None, f"x\n\n{notice}"),
        (None, f"x\n\n{notice}"),
        (6, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = sorted(((r.doc_id or 0, r.passages) for r in license_scan(docs, known_licenses(spark)).collect()))
    apache = ["Apache-2.0"]
    assert found == [(0, apache), (0, apache), (1, apache), (2, apache), (3, []), (4, ["MIT", "MPL-2.0"]), (5, []), (6, [])]


def test_first_words_pass_every_line_over_that_could_match(spark):
    """Lines are canonicalised only where they begin as a known text does: the
    same notices as without that, also for other spellings and signs before."""
    from dictgraph.llm import licenses as L

    known = spark.createDataFrame(
        [("a", "Sublicense freely"), ("b", "Licensed to all"), ("c", "Non commercial use"), ("d", "Copyright 2020 X\nProgram text"), ("e", "sub way")],
        "license_id string, text string",
    )
    lines = ["sub license FREELY", "  // Sub-licence freely", "licenced to all.", "noncommercial use", "Programme text", "sub way", "(c) 2020 Y", "x sublicense freely", "", "é"]
    docs = spark.createDataFrame([(i, f"other words\n{line}\nend") for i, line in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.notices for r in L.license_scan(docs, known).collect()}
    most, L.FIRST_WORDS = L.FIRST_WORDS, 0  # no first word is looked for
    try:
        assert got == {r.doc_id: r.notices for r in L.license_scan(docs, known).collect()}
    finally:
        L.FIRST_WORDS = most
    assert [got[i] for i in range(10)] == [["a"], ["a"], ["b"], ["c"], ["d"], ["e"], [], [], [], []]
