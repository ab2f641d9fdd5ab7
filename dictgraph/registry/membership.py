"""Registered queries of literal membership and validation (O4, O4b, O4c)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dictgraph import oracle_sql as osql
from dictgraph.operators.membership import check_membership, membership_pairs, validate_column

from dictgraph.registry.common import _long, dictionary, tables

# ------------------------------------------------------------------ O4c

def q_validate_events(spark, sf_dir, mode="flag"):
    d = dictionary(spark, sf_dir)
    (events,) = tables(spark, sf_dir, "events")
    fact = events.select("event_id", "event_type")
    out = validate_column(fact, F.concat(F.lit("event_kind_"), F.col("event_type")), "event_kind", d["edges"], mode=mode)
    return out


ORACLE_VALIDATE = {
    "flag": """SELECT event_id, event_type, EXISTS (SELECT 1 FROM edges e WHERE e._from = concat('terms/event_kind_', ev.event_type)
               AND e._predicate = '_predicate_enum-of' AND list_contains(e._path, 'terms/event_kind')) AS is_valid FROM events ev""",
    "valid": """SELECT event_id, event_type FROM events ev WHERE EXISTS (SELECT 1 FROM edges e WHERE e._from = concat('terms/event_kind_', ev.event_type)
               AND e._predicate = '_predicate_enum-of' AND list_contains(e._path, 'terms/event_kind'))""",
    "invalid": """SELECT event_id, event_type FROM events ev WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e._from = concat('terms/event_kind_', ev.event_type)
               AND e._predicate = '_predicate_enum-of' AND list_contains(e._path, 'terms/event_kind'))""",
}

def q_validate_lineitem_parts(spark, sf_dir):
    """Every line item's part checked against the ``part`` enumeration."""
    d = dictionary(spark, sf_dir)
    (lineitem,) = tables(spark, sf_dir, "lineitem")
    fact = lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    out = validate_column(fact, F.concat(F.lit("part_item_"), F.col("l_partkey").cast("string")), "part", d["edges"])
    return out.select(*_long("l_orderkey", "l_linenumber", "l_partkey"), "is_valid")


ORACLE_VALIDATE_LINEITEM = """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(l_partkey AS BIGINT) AS l_partkey,
       EXISTS (SELECT 1 FROM edges e WHERE e._from = concat('terms/part_item_', CAST(l.l_partkey AS STRING))
               AND e._predicate = '_predicate_enum-of' AND list_contains(e._path, 'terms/part')) AS is_valid
FROM lineitem l"""


# ------------------------------------------------------------------ O4 / O4b

MEMBERSHIP_ROOTS = ["geo", "mkt", "supply", "nation_code"]


def _membership_inputs(spark, sf_dir):
    customer, orders, supplier = tables(spark, sf_dir, "customer", "orders", "supplier")
    terms_req = reduce(
        DataFrame.unionByName,
        [
            customer.select((F.col("c_custkey") * 3).alias("pos"), F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("gid")),
            orders.select((F.col("o_orderkey") * 3 + 1).alias("pos"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("gid")),
            supplier.select((F.col("s_suppkey") * 3 + 2).alias("pos"), F.concat(F.lit("supp_"), F.col("s_suppkey").cast("string")).alias("gid")),
        ],
    )
    roots_req = spark.createDataFrame(list(enumerate(MEMBERSHIP_ROOTS)), "pos long, gid string")
    return terms_req, roots_req


_MEMBERSHIP_REQ_SQL = """
treq AS (
  SELECT c_custkey * 3 AS pos, concat('cust_', CAST(c_custkey AS STRING)) AS gid FROM customer
  UNION ALL SELECT o_orderkey * 3 + 1, concat('order_', CAST(o_orderkey AS STRING)) FROM orders
  UNION ALL SELECT s_suppkey * 3 + 2, concat('supp_', CAST(s_suppkey AS STRING)) FROM supplier
),
rreq AS (SELECT * FROM (VALUES (0, 'geo'), (1, 'mkt'), (2, 'supply'), (3, 'nation_code')) v(pos, gid)),
pairs AS (
  SELECT DISTINCT t.gid AS term, r.gid AS root
  FROM (SELECT DISTINCT gid FROM treq) t JOIN membership m ON m.leaf = concat('terms/', t.gid)
  JOIN (SELECT DISTINCT gid FROM rreq) r ON m.root_h = concat('terms/', r.gid)
)"""


def q_membership_counts(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    terms_req, roots_req = _membership_inputs(spark, sf_dir)
    out = check_membership(terms_req, roots_req, d["edges"])
    return out.select(
        "gid",
        F.col("pos").cast("long").alias("pos"),
        F.size("roots").cast("long").alias("n_roots"),
        F.array_join("roots", ",").alias("roots_csv"),
    )


ORACLE_MEMBERSHIP_COUNTS = osql.with_(
    """
SELECT t.gid, CAST(t.pos AS BIGINT) AS pos, CAST(count(p.root) AS BIGINT) AS n_roots,
       coalesce(string_agg(p.root, ',' ORDER BY r.pos), '') AS roots_csv
FROM (SELECT gid, min(pos) AS pos FROM treq GROUP BY gid) t
LEFT JOIN pairs p ON p.term = t.gid
LEFT JOIN rreq r ON r.gid = p.root
GROUP BY t.gid, t.pos""",
    extra=_MEMBERSHIP_REQ_SQL,
)


def q_membership_outbound(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    region, nation, customer = tables(spark, sf_dir, "region", "nation", "customer")
    terms_req = reduce(
        DataFrame.unionByName,
        [
            region.select((F.col("r_regionkey") * 3).cast("long").alias("pos"), F.concat(F.lit("geo_region_"), F.col("r_regionkey").cast("string")).alias("gid")),
            nation.select((F.col("n_nationkey") * 3 + 1).cast("long").alias("pos"), F.concat(F.lit("geo_nation_"), F.col("n_nationkey").cast("string")).alias("gid")),
            customer.select((F.col("c_custkey") * 3 + 2).cast("long").alias("pos"), F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("gid")),
        ],
    )
    roots_req = spark.createDataFrame(list(enumerate(MEMBERSHIP_ROOTS)), "pos long, gid string")
    out = check_membership(terms_req, roots_req, d["edges"], direction="outbound")
    return out.select("gid", F.col("pos").cast("long").alias("pos"), F.size("roots").cast("long").alias("n_roots"), F.array_join("roots", ",").alias("roots_csv"))


ORACLE_MEMBERSHIP_OUTBOUND = osql.with_(
    """
SELECT t.gid, CAST(t.pos AS BIGINT) AS pos, CAST(count(r.gid) AS BIGINT) AS n_roots,
       coalesce(string_agg(r.gid, ',' ORDER BY r.pos), '') AS roots_csv
FROM treq t
LEFT JOIN (SELECT DISTINCT _to AS leaf, unnest(list_distinct(_path)) AS root_h FROM edges WHERE _predicate = '_predicate_enum-of') m
  ON m.leaf = concat('terms/', t.gid)
LEFT JOIN rreq r ON m.root_h = concat('terms/', r.gid)
GROUP BY t.gid, t.pos""",
    extra="""
treq AS (
  SELECT r_regionkey * 3 AS pos, concat('geo_region_', CAST(r_regionkey AS STRING)) AS gid FROM region
  UNION ALL SELECT n_nationkey * 3 + 1, concat('geo_nation_', CAST(n_nationkey AS STRING)) FROM nation
  UNION ALL SELECT c_custkey * 3 + 2, concat('cust_', CAST(c_custkey AS STRING)) FROM customer
),
rreq AS (SELECT * FROM (VALUES (0, 'geo'), (1, 'mkt'), (2, 'supply'), (3, 'nation_code')) v(pos, gid))""",
)


def q_membership_pairs(spark, sf_dir):
    d = dictionary(spark, sf_dir)
    terms_req, roots_req = _membership_inputs(spark, sf_dir)
    return membership_pairs(terms_req, roots_req, d["edges"])


ORACLE_MEMBERSHIP_PAIRS = osql.with_("SELECT term, root FROM pairs", extra=_MEMBERSHIP_REQ_SQL)
