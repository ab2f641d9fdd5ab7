"""Registered queries of hierarchy expansion and graph-aware resolution (O3, O5, O6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dictgraph import oracle_sql as osql
from dictgraph.operators.expand import expand_enum
from dictgraph.operators.membership import resolve_then_check
from dictgraph.operators.resolve import resolve_in_graph

from dictgraph.registry.common import _long, dictionary, tables

# ------------------------------------------------------------------ O3


def _expand_out(df):
    return df.select(*_long("request_id"), "gid", "predicate", *_long("level"), "parent", *_long("hops"))


def q_expand_geo_l4(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    req = _all_roots(d["edges"]).filter(F.col("root") == "geo").select(F.lit(1).cast("long").alias("request_id"), "root")
    return _expand_out(expand_enum(req, d["edges"], levels=4))


EXPAND_GEO_REQ = "SELECT DISTINCT CAST(1 AS BIGINT) AS request_id, 'geo' AS root, CAST(NULL AS VARCHAR) AS branch FROM edges WHERE list_contains(_path, 'terms/geo')"


def q_expand_regions(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (region,) = tables(spark, sf_dir, "region")
    req = region.select(
        F.col("r_regionkey").cast("long").alias("request_id"),
        F.lit("geo").alias("root"),
        F.concat(F.lit("geo_region_"), F.col("r_regionkey").cast("string")).alias("branch"),
    )
    return _expand_out(expand_enum(req, d["edges"], levels=3))


EXPAND_REGIONS_REQ = "SELECT CAST(r_regionkey AS BIGINT) AS request_id, 'geo' AS root, concat('geo_region_', CAST(r_regionkey AS STRING)) AS branch FROM region"


def q_expand_branch_nations(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (nation,) = tables(spark, sf_dir, "nation")
    req = nation.select(
        F.col("n_nationkey").cast("long").alias("request_id"),
        F.lit("geo").alias("root"),
        F.concat(F.lit("geo_nation_"), F.col("n_nationkey").cast("string")).alias("branch"),
    )
    return _expand_out(expand_enum(req, d["edges"], levels=2))


EXPAND_NATIONS_REQ = "SELECT CAST(n_nationkey AS BIGINT) AS request_id, 'geo' AS root, concat('geo_nation_', CAST(n_nationkey AS STRING)) AS branch FROM nation"


def _all_roots(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.explode(F.array_distinct("_path")).alias("root_h")).distinct()
    return roots.select(F.expr("substr(root_h, 7)").alias("root"))


def q_expand_all_roots(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    req = _all_roots(d["edges"]).select(F.xxhash64("root").alias("request_id"), "root")
    out = expand_enum(req, d["edges"], levels=2)
    return out.join(req, "request_id").select(
        "root", "gid", "predicate", F.col("level").cast("long").alias("level"), "parent", F.col("hops").cast("long").alias("hops")
    )


def _root_request(edges: DataFrame, root: str) -> DataFrame:
    """The request for one graph, taken from the roots present in the edges."""
    return _all_roots(edges).filter(F.col("root") == root).select(F.lit(1).cast("long").alias("request_id"), "root")


def single_root_query(root: str, levels: int):
    def run(spark, sf_dir):
        d = dictionary(spark, sf_dir)
        return _expand_out(expand_enum(_root_request(d["edges"], root), d["edges"], levels=levels))

    return run


def single_root_oracle(root: str, levels: int) -> str:
    req = (
        "SELECT DISTINCT CAST(1 AS BIGINT) AS request_id, '" + root + "' AS root, CAST(NULL AS VARCHAR) AS branch "
        "FROM edges WHERE list_contains(_path, 'terms/" + root + "')"
    )
    return osql.expand_sql(req, levels)


SINGLE_ROOT_EXPANSIONS = {
    "expand_geo_l1": ("geo", 1),
    "expand_bridge_nation_code": ("nation_code", 1),
    "expand_multi_parent_part": ("part", 2),
    "expand_supply_l3": ("supply", 3),
    "expand_mkt_l2": ("mkt", 2),
}


def q_expand_geo_full(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    out = expand_enum(_root_request(d["edges"], "geo"), d["edges"], d["terms"], levels=2, shape="full")
    return out.select(
        *_long("request_id"), "gid", "predicate", *_long("level"), "parent",
        F.try_variant_get("term", "$._info._title.ISO_639_3_eng", "string").alias("title"),
        F.col("term").isNotNull().alias("has_term"),
    )


def oracle_expand_geo_full() -> str:
    sql = single_root_oracle("geo", 2)
    head, body = sql.rsplit("SELECT CAST(request_id AS BIGINT) AS request_id", 1)
    return head + """SELECT CAST(b.request_id AS BIGINT) AS request_id, substr(b.vertex, 7) AS gid, b.predicate, CAST(b.level AS BIGINT) AS level,
       b.parent, json_extract_string(t.doc, '$._info._title.ISO_639_3_eng') AS title, t._key IS NOT NULL AS has_term
FROM best b LEFT JOIN terms t ON concat('terms/', t._key) = b.vertex WHERE NOT b.is_bridge AND b.level <= 2"""


def q_expand_outbound_orders(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (orders,) = tables(spark, sf_dir, "orders")
    req = orders.select(
        F.col("o_orderkey").cast("long").alias("request_id"),
        F.lit("geo").alias("root"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("branch"),
    )
    return _expand_out(expand_enum(req, d["edges"], levels=4, direction="outbound"))


EXPAND_ORDERS_REQ = "SELECT CAST(o_orderkey AS BIGINT) AS request_id, 'geo' AS root, concat('order_', CAST(o_orderkey AS STRING)) AS branch FROM orders"


def oracle_all_roots() -> str:
    req = "SELECT DISTINCT 0 AS request_id, substr(root_h, 7) AS root, CAST(NULL AS VARCHAR) AS branch FROM (SELECT unnest(list_distinct(_path)) AS root_h FROM edges)"
    # request ids are irrelevant once the root is reported: use the root.
    sql = osql.expand_sql(req.replace("0 AS request_id", "substr(root_h, 7) AS request_id"), 2)
    sql = sql.replace("CAST(request_id AS BIGINT) AS request_id", "request_id AS root")
    return sql


# ------------------------------------------------------------------ O5 / O6


def _resolve_out(df):
    return df.select(*_long("request_id"), "target", "resolved_gid", "status", *_long("hops"))


def _geo_targets(spark, sf_dir):
    region, nation, customer, orders = tables(spark, sf_dir, "region", "nation", "customer", "orders")
    return reduce(
        DataFrame.unionByName,
        [
            region.select((F.col("r_regionkey") * 4).cast("long").alias("request_id"), F.concat(F.lit("geo_region_"), F.col("r_regionkey").cast("string")).alias("target")),
            nation.select((F.col("n_nationkey") * 4 + 1).cast("long").alias("request_id"), F.concat(F.lit("geo_nation_"), F.col("n_nationkey").cast("string")).alias("target")),
            customer.select((F.col("c_custkey") * 4 + 2).cast("long").alias("request_id"), F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("target")),
            orders.select((F.col("o_orderkey") * 4 + 3).cast("long").alias("request_id"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("target")),
        ],
    )


GEO_TARGETS_SQL = """
SELECT r_regionkey * 4 AS request_id, concat('geo_region_', CAST(r_regionkey AS STRING)) AS target FROM region
UNION ALL SELECT n_nationkey * 4 + 1, concat('geo_nation_', CAST(n_nationkey AS STRING)) FROM nation
UNION ALL SELECT c_custkey * 4 + 2, concat('cust_', CAST(c_custkey AS STRING)) FROM customer
UNION ALL SELECT o_orderkey * 4 + 3, concat('order_', CAST(o_orderkey AS STRING)) FROM orders"""


def q_resolve_in_geo(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    req = _geo_targets(spark, sf_dir).withColumn("root", F.lit("geo"))
    return _resolve_out(resolve_in_graph(req, d["edges"], d["terms"], with_doc=False))


def q_resolve_in_supply(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (supplier,) = tables(spark, sf_dir, "supplier")
    req = _geo_targets(spark, sf_dir).unionByName(
        supplier.select((F.col("s_suppkey") * 4 + 100_000_000).cast("long").alias("request_id"), F.concat(F.lit("supp_"), F.col("s_suppkey").cast("string")).alias("target"))
    ).withColumn("root", F.lit("supply"))
    return _resolve_out(resolve_in_graph(req, d["edges"], d["terms"], with_doc=False))


def q_resolve_nation_code(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (nation, supplier) = tables(spark, sf_dir, "nation", "supplier")
    req = reduce(
        DataFrame.unionByName,
        [
            nation.select((F.col("n_nationkey") * 3).cast("long").alias("request_id"), F.concat(F.lit("nation_code_"), F.col("n_nationkey").cast("string")).alias("target")),
            nation.select((F.col("n_nationkey") * 3 + 1).cast("long").alias("request_id"), F.concat(F.lit("geo_nation_"), F.col("n_nationkey").cast("string")).alias("target")),
            supplier.select((F.col("s_suppkey") * 3 + 2).cast("long").alias("request_id"), F.concat(F.lit("supp_"), F.col("s_suppkey").cast("string")).alias("target")),
        ],
    ).withColumn("root", F.lit("nation_code"))
    return _resolve_out(resolve_in_graph(req, d["edges"], d["terms"], with_doc=False))


NATION_CODE_TARGETS_SQL = """
SELECT n_nationkey * 3 AS request_id, concat('nation_code_', CAST(n_nationkey AS STRING)) AS target, 'nation_code' AS root FROM nation
UNION ALL SELECT n_nationkey * 3 + 1, concat('geo_nation_', CAST(n_nationkey AS STRING)), 'nation_code' FROM nation
UNION ALL SELECT s_suppkey * 3 + 2, concat('supp_', CAST(s_suppkey AS STRING)), 'nation_code' FROM supplier"""


def oracle_resolve(req_sql: str) -> str:
    extra = osql.resolve_sql(req_sql)
    body = """
SELECT CAST(q.request_id AS BIGINT) AS request_id, q.target, g.resolved_gid, g.status, CAST(g.hops AS BIGINT) AS hops
FROM req q JOIN resolved_graph g ON g.request_id = q.request_id"""
    return osql.with_(body, recursive=True, extra=extra)


SECTION_PREDICATE = "_predicate_section-of"
SECTION_TRAVERSE = ["_predicate_enum-of"]


def q_resolve_geo_by_section(spark, sf_dir):
    """Resolution with a non-default functional predicate and traverse list:
    sections are canonical, enum-of edges are walked (inbound, 3 levels)."""
    d = dictionary(spark, sf_dir)
    region, nation = tables(spark, sf_dir, "region", "nation")
    req = region.select((F.col("r_regionkey") * 2).cast("long").alias("request_id"), F.concat(F.lit("geo_region_"), F.col("r_regionkey").cast("string")).alias("target")).unionByName(
        nation.select((F.col("n_nationkey") * 2 + 1).cast("long").alias("request_id"), F.concat(F.lit("geo_nation_"), F.col("n_nationkey").cast("string")).alias("target"))
    ).withColumn("root", F.lit("geo"))
    out = resolve_in_graph(req, d["edges"], d["terms"], predicate=SECTION_PREDICATE, traverse=SECTION_TRAVERSE, levels=3, with_doc=False)
    return _resolve_out(out)


def oracle_resolve_geo_by_section() -> str:
    req = """SELECT r_regionkey * 2 AS request_id, concat('geo_region_', CAST(r_regionkey AS STRING)) AS target, 'geo' AS root FROM region
UNION ALL SELECT n_nationkey * 2 + 1, concat('geo_nation_', CAST(n_nationkey AS STRING)), 'geo' FROM nation"""
    extra = osql.resolve_sql(req, levels=3, predicate=SECTION_PREDICATE, traverse=tuple(SECTION_TRAVERSE))
    body = """
SELECT CAST(q.request_id AS BIGINT) AS request_id, q.target, g.resolved_gid, g.status, CAST(g.hops AS BIGINT) AS hops
FROM req q JOIN resolved_graph g ON g.request_id = q.request_id"""
    return osql.with_(body, recursive=True, extra=extra)


def q_resolve_then_check_customers(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    (customer,) = tables(spark, sf_dir, "customer")
    fact = customer.select("c_custkey", F.concat(F.lit("nation_code_"), F.col("c_nationkey").cast("string")).alias("code"))
    out = resolve_then_check(fact, "code", "nation_code", d["terms"], d["edges"])
    return out.select(*_long("c_custkey"), "code", "resolved_gid", "is_valid")


_RTC_REQ = "SELECT DISTINCT concat('nation_code_', CAST(c_nationkey AS STRING)) AS request_id, 'nation_code' AS root, concat('nation_code_', CAST(c_nationkey AS STRING)) AS target FROM customer"

ORACLE_RESOLVE_THEN_CHECK = osql.with_(
    """
SELECT CAST(c.c_custkey AS BIGINT) AS c_custkey, concat('nation_code_', CAST(c.c_nationkey AS STRING)) AS code, g.resolved_gid,
       coalesce(EXISTS (SELECT 1 FROM membership m WHERE m.leaf = concat('terms/', g.resolved_gid) AND m.root_h = 'terms/nation_code'), false) AS is_valid
FROM customer c LEFT JOIN resolved_graph g ON g.request_id = concat('nation_code_', CAST(c.c_nationkey AS STRING))""",
    recursive=True,
    extra=osql.resolve_sql(_RTC_REQ),
)
