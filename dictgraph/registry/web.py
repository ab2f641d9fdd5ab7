"""Registered queries over a graph with the shapes that hierarchies lack: cycles,
diamonds, bridges behind bridges, parents that tie, far ends that lie on the
walked path, vertices without a document (O3, O5).

Vertex ``web_k`` stands for customer ``k``; every rule is arithmetic on ``k``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dictgraph import oracle_sql as osql
from dictgraph.functions.constants import BRIDGE_OF, ENUM_OF, SECTION_OF
from dictgraph.operators.expand import expand_enum
from dictgraph.operators.resolve import resolve_in_graph
from dictgraph.plans.lineage import cut_lineage
from dictgraph.registry.common import _long, tables
from dictgraph.sources.dictionary import terms_from_json

# (from, to, predicate, which customers): SQL over the customer's number k
RULES = [
    ("k", "k div 2", SECTION_OF, "k >= 2"),
    ("k", "k div 3", BRIDGE_OF, "k >= 3"),
    ("k", "k div 5", ENUM_OF, "k >= 5 and k % 4 = 0"),
    ("k div 4", "k", SECTION_OF, "k >= 4 and k % 3 = 0"),  # back up: cycles
    ("k div 2", "k", ENUM_OF, "k >= 2 and k % 7 = 0"),  # far end on the path
    ("k div 6", "k", BRIDGE_OF, "k >= 6 and k % 5 = 0"),
]


def web(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers' numbers, edges and terms."""
    (customer,) = tables(spark, sf_dir, "customer")
    k = customer.select(F.col("c_custkey").cast("long").alias("k"))
    name = "concat('terms/web_', cast({} as string))"
    raw = reduce(
        DataFrame.unionByName,
        [k.where(w).selectExpr(f"{name.format(f)} AS _from", f"{name.format(t)} AS _to", f"'{p}' AS _predicate") for f, t, p, w in RULES],
    )
    edges = raw.select(
        F.md5(F.concat_ws("|", "_from", "_predicate", "_to")).alias("_key"),
        "_from",
        "_to",
        "_predicate",
        F.array(F.lit("terms/web")).alias("_path"),
    )
    docs = k.where("k % 11 <> 0").selectExpr(
        "concat('web_', cast(k as string)) AS _key", """concat('{"_code":{"_gid":"web_', cast(k as string), '"},"_info":{}}') AS doc"""
    )
    return k, cut_lineage(edges), cut_lineage(terms_from_json(docs))


def _web_sql() -> str:
    name = "concat('terms/web_', CAST({} AS VARCHAR))"
    rows = [
        f"SELECT {name.format(f.replace(' div ', ' // '))} AS _from, {name.format(t.replace(' div ', ' // '))} AS _to, '{p}' AS _predicate "
        f"FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) WHERE {w}"
        for f, t, p, w in RULES
    ]
    return f"""
edges AS (SELECT md5(concat(_from, '|', _predicate, '|', _to)) AS _key, _from, _to, _predicate, ['terms/web'] AS _path FROM ({" UNION ALL ".join(rows)})),
terms AS (SELECT concat('web_', CAST(c_custkey AS VARCHAR)) AS _key FROM customer WHERE c_custkey % 11 <> 0)"""


def q_expand_web(spark, sf_dir, direction: str = "inbound"):
    k, edges, _ = web(spark, sf_dir)
    req = k.select(F.col("k").alias("request_id"), F.lit("web").alias("root"), F.expr("concat('web_', cast(k as string))").alias("branch"))
    out = expand_enum(req, edges, levels=3, direction=direction)
    return out.select(*_long("request_id"), "gid", "predicate", *_long("level"), "parent", *_long("hops"))


def q_expand_web_outbound(spark, sf_dir):
    return q_expand_web(spark, sf_dir, "outbound")


def q_expand_web_full(spark, sf_dir):
    """Two levels with documents; a vertex without one keeps its row."""
    k, edges, terms = web(spark, sf_dir)
    req = k.select(F.col("k").alias("request_id"), F.lit("web").alias("root"), F.expr("concat('web_', cast(k as string))").alias("branch"))
    out = expand_enum(req, edges, terms, levels=2, shape="full")
    return out.select(*_long("request_id"), "gid", *_long("level"), F.col("term").isNotNull().alias("has_term"))


def _resolve(spark, sf_dir, direction: str):
    k, edges, terms = web(spark, sf_dir)
    req = k.select(F.col("k").alias("request_id"), F.lit("web").alias("root"), F.expr("concat('web_', cast(k as string))").alias("target"))
    out = resolve_in_graph(req, edges, terms, levels=4, direction=direction, with_doc=False)
    return out.select(*_long("request_id"), "target", "resolved_gid", "status", *_long("hops"))


def q_resolve_web(spark, sf_dir):
    return _resolve(spark, sf_dir, "inbound")


def q_resolve_web_outbound(spark, sf_dir):
    return _resolve(spark, sf_dir, "outbound")


_BRANCHES = "SELECT CAST(c_custkey AS BIGINT) AS request_id, 'web' AS root, concat('web_', CAST(c_custkey AS VARCHAR)) AS branch FROM customer"
_TARGETS = _BRANCHES.replace("AS branch", "AS target")


def _expand_oracle(direction: str) -> str:
    return f"WITH {_web_sql()}, {osql.expand_ctes(_BRANCHES, 3, direction)} {osql.expand_body(3)}"


def _resolve_oracle(direction: str) -> str:
    return f"""WITH RECURSIVE {_web_sql()}, {osql.resolve_sql(_TARGETS, levels=4, direction=direction)}
SELECT q.request_id, q.target, g.resolved_gid, g.status, CAST(g.hops AS BIGINT) AS hops
FROM req q JOIN resolved_graph g ON g.request_id = q.request_id"""


QUERIES = {
    "expand_web": q_expand_web,
    "expand_web_outbound": q_expand_web_outbound,
    "expand_web_full": q_expand_web_full,
    "resolve_web": q_resolve_web,
    "resolve_web_outbound": q_resolve_web_outbound,
}

ORACLE = {
    "expand_web": _expand_oracle("inbound"),
    "expand_web_outbound": _expand_oracle("outbound"),
    "expand_web_full": f"""WITH {_web_sql()}, {osql.expand_ctes(_BRANCHES, 2)}
SELECT b.request_id, substr(b.vertex, 7) AS gid, CAST(b.level AS BIGINT) AS level, t._key IS NOT NULL AS has_term
FROM best b LEFT JOIN terms t ON concat('terms/', t._key) = b.vertex WHERE NOT b.is_bridge AND b.level <= 2""",
    "resolve_web": _resolve_oracle("inbound"),
    "resolve_web_outbound": _resolve_oracle("outbound"),
}
