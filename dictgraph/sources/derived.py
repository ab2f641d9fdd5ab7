"""A metadata dictionary derived from the driver's relational tables.

The driver ships no dictionary, so one is built from its parquet tables:

* ``geo``          region (section) <- nation <- customer <- order
* ``supply``       shares the nation edges (their ``_path`` has two roots)
* ``nation_code``  alias shells behind bridges, canonical nations behind them
* ``mkt``          market-segment sections over customers
* ``part``         every item under both a type and a brand section (ties)
* ``event_kind``   event types, deliberately without ``error``
* ``_predicate_field-of`` noise edges that every operator must ignore.

Only a subset of endpoints gets a term document; the rest dangle on purpose.
Everything is a plain DataFrame expression, so its size follows the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictgraph.functions.constants import BRIDGE_OF, ENUM_OF, SECTION_OF
from dictgraph.functions.keys import blob_key, handle
from dictgraph.plans.sizing import spread_rows
from dictgraph.sources.dictionary import prepare_terms, terms_from_json

FIELD_OF = "_predicate_field-of"

# The tables that give an edge or a term a row, and their columns in use. A row
# becomes many times longer, so they are dealt anew before, by rows: a file's few
# row groups would make as few partitions, in which all later work stays.
SPREAD = {
    "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "part": ["p_partkey", "p_name", "p_type", "p_brand", "p_size"],
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _s(c) -> F.Column:
    return F.col(c).cast("string")


def _edge(df: DataFrame, f, t, p: str, g: str) -> DataFrame:
    return df.select(f.alias("f"), t.alias("t"), F.lit(p).alias("p"), F.lit(g).alias("g"))


def _edges_per_row(df: DataFrame, *specs) -> DataFrame:
    """Several edges from each row of one scan: ``explode`` over an array of
    ``(f, t, p, g)`` structs."""
    structs = [
        F.struct(f.alias("f"), t.alias("t"), F.lit(p).alias("p"), F.lit(g).alias("g")) for f, t, p, g in specs
    ]
    return df.select(F.explode(F.array(*structs)).alias("e")).select("e.f", "e.t", "e.p", "e.g")


def derive_edges(t: dict[str, DataFrame]) -> DataFrame:
    region, nation, customer = t["region"], t["nation"], t["customer"]
    supplier, orders, part, events = t["supplier"], t["orders"], t["part"], t["events"]
    h = handle
    region_h = h(F.concat(F.lit("geo_region_"), _s("r_regionkey")))
    nation_h = h(F.concat(F.lit("geo_nation_"), _s("n_nationkey")))
    code_h = h(F.concat(F.lit("nation_code_"), _s("n_nationkey")))
    cust_h = h(F.concat(F.lit("cust_"), _s("c_custkey")))
    mkt_h = h(F.concat(F.lit("mkt_"), F.col("c_mktsegment")))
    item_h = h(F.concat(F.lit("part_item_"), _s("p_partkey")))
    type_h = h(F.concat(F.lit("part_type_"), F.col("p_type")))
    brand_h = h(F.concat(F.lit("part_brand_"), F.col("p_brand")))
    parts = [
        _edges_per_row(
            region,
            (region_h, F.lit("terms/geo"), SECTION_OF, "terms/geo"),
            (region_h, F.lit("terms/supply"), SECTION_OF, "terms/supply"),
        ),
        _edges_per_row(
            nation,
            (nation_h, h(F.concat(F.lit("geo_region_"), _s("n_regionkey"))), ENUM_OF, "terms/geo,terms/supply"),
            (nation_h, code_h, ENUM_OF, "terms/nation_code"),
            (code_h, F.lit("terms/nation_code"), BRIDGE_OF, "terms/nation_code"),
            (nation_h, F.lit("terms/geo"), FIELD_OF, "terms/geo"),
        ),
        _edges_per_row(
            customer,
            (cust_h, h(F.concat(F.lit("geo_nation_"), _s("c_nationkey"))), ENUM_OF, "terms/geo"),
            (cust_h, mkt_h, ENUM_OF, "terms/mkt"),
        ),
        _edge(customer, mkt_h, F.lit("terms/mkt"), SECTION_OF, "terms/mkt").distinct(),
        _edge(supplier, h(F.concat(F.lit("supp_"), _s("s_suppkey"))), h(F.concat(F.lit("geo_nation_"), _s("s_nationkey"))), ENUM_OF, "terms/supply"),
        _edge(orders, h(F.concat(F.lit("order_"), _s("o_orderkey"))), h(F.concat(F.lit("cust_"), _s("o_custkey"))), ENUM_OF, "terms/geo"),
        _edges_per_row(
            part,
            (item_h, type_h, ENUM_OF, "terms/part"),
            (item_h, brand_h, ENUM_OF, "terms/part"),
        ),
        _edges_per_row(
            part,
            (type_h, F.lit("terms/part"), SECTION_OF, "terms/part"),
            (brand_h, F.lit("terms/part"), SECTION_OF, "terms/part"),
        ).distinct(),
        _edge(events.filter(F.col("event_type") != "error"), h(F.concat(F.lit("event_kind_"), F.col("event_type"))), F.lit("terms/event_kind"), ENUM_OF, "terms/event_kind").distinct(),
    ]
    raw = reduce(DataFrame.unionByName, parts)
    return raw.select(
        F.md5(F.concat("f", F.lit("|"), "p", F.lit("|"), "t")).alias("_key"),
        F.col("f").alias("_from"),
        F.col("t").alias("_to"),
        F.col("p").alias("_predicate"),
        F.split("g", ",").alias("_path"),
    )


def _q(c) -> F.Column:
    """A string column as it appears between JSON quotes (escaped)."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def derive_term_text(t: dict[str, DataFrame]) -> DataFrame:
    """``(_key, doc)`` with ``doc`` as JSON text."""
    spark = t["region"].sparkSession
    lit_rows = spark.createDataFrame(
        [
            ("geo", '{"_code":{"_gid":"geo"},"_info":{"_title":{"ISO_639_3_eng":"Geography"}}}'),
            ("ghost_shell", '{"_code":{"_gid":"ghost_shell"}}'),
            ("null_info", '{"_code":{"_gid":"null_info"},"_info":null}'),
        ],
        "_key string, doc string",
    )
    rk, nk, pk = _s("r_regionkey"), _s("n_nationkey"), _s("p_partkey")
    regions = t["region"].select(
        F.concat(F.lit("geo_region_"), rk).alias("_key"),
        F.concat(F.lit('{"_code":{"_gid":"geo_region_'), rk, F.lit('"},"_info":{"_title":{"ISO_639_3_eng":"'), _q(F.col("r_name")), F.lit('"}}}')).alias("doc"),
    )
    nations = t["nation"].select(
        F.concat(F.lit("geo_nation_"), nk).alias("_key"),
        F.concat(
            F.lit('{"_code":{"_gid":"geo_nation_'), nk, F.lit('","_aid":["'), nk, F.lit('","'), _q(F.col("n_name")),
            F.lit('"]},"_info":{"_title":{"ISO_639_3_eng":"'), _q(F.col("n_name")), F.lit('"}},"_data":{"_scalar":{}}}'),
        ).alias("doc"),
    )
    codes = t["nation"].select(
        F.concat(F.lit("nation_code_"), nk).alias("_key"),
        F.concat(F.lit('{"_code":{"_gid":"nation_code_'), nk, F.lit('"}}')).alias("doc"),
    )
    brand, ptype = _q(F.col("p_brand")), _q(F.col("p_type"))
    items = t["part"].select(
        F.concat(F.lit("part_item_"), pk).alias("_key"),
        F.concat(
            F.lit('{"_code":{"_gid":"part_item_'), pk, F.lit('"},"_info":{"_title":{"ISO_639_3_eng":"'), _q(F.col("p_name")),
            F.lit('"}},"_domn":{"_term_role":["item"],"brand":"'), brand,
            F.lit('"},"_data":{"_object":{"_closed":{"_required":[{"_selection":["'), brand, F.lit('",["'), ptype,
            F.lit('",["size_'), _s("p_size"), F.lit('","'), brand, F.lit('"]]]}],"_recommended":["'), ptype,
            F.lit('","price"]}}}}'),
        ).alias("doc"),
    )
    return reduce(DataFrame.unionByName, [lit_rows, regions, nations, codes, items])


def derive_terms(t: dict[str, DataFrame]) -> DataFrame:
    return prepare_terms(terms_from_json(derive_term_text(t)))


def derive_blobs(t: dict[str, DataFrame]) -> DataFrame:
    pages = t["pages"]
    ident = _s("page_id")
    return pages.select(
        blob_key(F.lit("page"), F.lit("_text_HTML"), F.lit("_media_web"), ident).alias("_key"),
        F.lit("page").alias("_blob_item"),
        F.lit("_text_HTML").alias("_blob_type"),
        F.lit("_media_web").alias("_blob_kind"),
        ident.alias("_blob_identifier"),
        F.col("html").alias("_blob_content"),
    )


def derive_dictionary(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``{"terms", "edges", "blobs"}`` derived lazily from ``sf_dir``."""
    t = read_tables(spark, sf_dir, ["region", "nation", "customer", "supplier", "part", "orders", "events", "pages"])
    t |= {name: spread_rows(t[name].select(*columns)) for name, columns in SPREAD.items()}
    return {"terms": derive_terms(t), "edges": derive_edges(t), "blobs": derive_blobs(t)}
