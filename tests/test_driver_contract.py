"""The driver contract at sf0.001: entry() runs, every query of the registry has
an oracle, and every query with one equals it (same column names, same rows,
order-insensitive)."""

import math
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return "\0null" if v is None else v


def test_entry_and_keys(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["event_id", "event_type", "is_valid"]
    assert set(E.registry.QUERIES) == set(E.registry.ORACLE)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(scols) == sorted(ocols)
    idx = [ocols.index(c) for c in scols]
    orows = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    assert sorted(tuple(map(_norm, r)) for r in srows) == sorted(tuple(map(_norm, r)) for r in orows)
