"""DuckDB oracle SQL for the driver's correctness gate.

The dictionary is derived from the driver tables by the portable SQL below
(the same derivation ``sources.derived`` expresses with the DataFrame API);
each oracle query then states the operator's semantics in plain SQL.
Integer outputs are BIGINT on both sides.
"""

from __future__ import annotations

DERIVE = r"""
raw_e AS (
  SELECT concat('terms/geo_region_', CAST(r_regionkey AS STRING)) AS f, 'terms/geo' AS t, '_predicate_section-of' AS p, 'terms/geo' AS g FROM region
  UNION ALL SELECT concat('terms/geo_region_', CAST(r_regionkey AS STRING)), 'terms/supply', '_predicate_section-of', 'terms/supply' FROM region
  UNION ALL SELECT concat('terms/geo_nation_', CAST(n_nationkey AS STRING)), concat('terms/geo_region_', CAST(n_regionkey AS STRING)), '_predicate_enum-of', 'terms/geo,terms/supply' FROM nation
  UNION ALL SELECT concat('terms/geo_nation_', CAST(n_nationkey AS STRING)), concat('terms/nation_code_', CAST(n_nationkey AS STRING)), '_predicate_enum-of', 'terms/nation_code' FROM nation
  UNION ALL SELECT concat('terms/nation_code_', CAST(n_nationkey AS STRING)), 'terms/nation_code', '_predicate_bridge-of', 'terms/nation_code' FROM nation
  UNION ALL SELECT concat('terms/geo_nation_', CAST(n_nationkey AS STRING)), 'terms/geo', '_predicate_field-of', 'terms/geo' FROM nation
  UNION ALL SELECT concat('terms/cust_', CAST(c_custkey AS STRING)), concat('terms/geo_nation_', CAST(c_nationkey AS STRING)), '_predicate_enum-of', 'terms/geo' FROM customer
  UNION ALL SELECT concat('terms/supp_', CAST(s_suppkey AS STRING)), concat('terms/geo_nation_', CAST(s_nationkey AS STRING)), '_predicate_enum-of', 'terms/supply' FROM supplier
  UNION ALL SELECT DISTINCT concat('terms/mkt_', c_mktsegment), 'terms/mkt', '_predicate_section-of', 'terms/mkt' FROM customer
  UNION ALL SELECT concat('terms/cust_', CAST(c_custkey AS STRING)), concat('terms/mkt_', c_mktsegment), '_predicate_enum-of', 'terms/mkt' FROM customer
  UNION ALL SELECT concat('terms/order_', CAST(o_orderkey AS STRING)), concat('terms/cust_', CAST(o_custkey AS STRING)), '_predicate_enum-of', 'terms/geo' FROM orders
  UNION ALL SELECT DISTINCT concat('terms/part_type_', p_type), 'terms/part', '_predicate_section-of', 'terms/part' FROM part
  UNION ALL SELECT DISTINCT concat('terms/part_brand_', p_brand), 'terms/part', '_predicate_section-of', 'terms/part' FROM part
  UNION ALL SELECT concat('terms/part_item_', CAST(p_partkey AS STRING)), concat('terms/part_type_', p_type), '_predicate_enum-of', 'terms/part' FROM part
  UNION ALL SELECT concat('terms/part_item_', CAST(p_partkey AS STRING)), concat('terms/part_brand_', p_brand), '_predicate_enum-of', 'terms/part' FROM part
  UNION ALL SELECT DISTINCT concat('terms/event_kind_', event_type), 'terms/event_kind', '_predicate_enum-of', 'terms/event_kind' FROM events WHERE event_type <> 'error'
),
edges AS (SELECT md5(concat(f, '|', p, '|', t)) AS _key, f AS _from, t AS _to, p AS _predicate, split(g, ',') AS _path FROM raw_e),
terms AS (
  SELECT 'geo' AS _key, '{"_code":{"_gid":"geo"},"_info":{"_title":{"ISO_639_3_eng":"Geography"}}}' AS doc
  UNION ALL SELECT 'ghost_shell', '{"_code":{"_gid":"ghost_shell"}}'
  UNION ALL SELECT 'null_info', '{"_code":{"_gid":"null_info"},"_info":null}'
  UNION ALL SELECT concat('geo_region_', CAST(r_regionkey AS STRING)), concat('{"_code":{"_gid":"geo_region_', CAST(r_regionkey AS STRING), '"},"_info":{"_title":{"ISO_639_3_eng":"', r_name, '"}}}') FROM region
  UNION ALL SELECT concat('geo_nation_', CAST(n_nationkey AS STRING)), concat('{"_code":{"_gid":"geo_nation_', CAST(n_nationkey AS STRING), '","_aid":["', CAST(n_nationkey AS STRING), '","', n_name, '"]},"_info":{"_title":{"ISO_639_3_eng":"', n_name, '"}},"_data":{"_scalar":{}}}') FROM nation
  UNION ALL SELECT concat('nation_code_', CAST(n_nationkey AS STRING)), concat('{"_code":{"_gid":"nation_code_', CAST(n_nationkey AS STRING), '"}}') FROM nation
  UNION ALL SELECT concat('part_item_', CAST(p_partkey AS STRING)), concat('{"_code":{"_gid":"part_item_', CAST(p_partkey AS STRING), '"},"_info":{"_title":{"ISO_639_3_eng":"', p_name, '"}},"_domn":{"_term_role":["item"],"brand":"', p_brand, '"},"_data":{"_object":{"_closed":{"_required":[{"_selection":["', p_brand, '",["', p_type, '",["size_', CAST(p_size AS STRING), '","', p_brand, '"]]]}],"_recommended":["', p_type, '","price"]}}}}') FROM part
),
blobs AS (SELECT md5(concat('page', '/', '_text_HTML', '/', '_media_web', '/', CAST(page_id AS STRING))) AS _key, 'page' AS _blob_item, '_text_HTML' AS _blob_type, '_media_web' AS _blob_kind, CAST(page_id AS STRING) AS _blob_identifier, html AS _blob_content FROM pages),
tflags AS (
  SELECT _key, doc,
         NOT (list_contains(json_keys(doc), '_info') OR list_contains(json_keys(doc), '_data')) AS is_alias
  FROM terms
),
alias_map AS (
  SELECT e._to AS shell_h, min(e._from) AS canonical_h
  FROM edges e JOIN tflags t ON e._to = concat('terms/', t._key)
  WHERE t.is_alias AND e._predicate = '_predicate_enum-of'
  GROUP BY e._to
),
membership AS (
  SELECT DISTINCT _from AS leaf, unnest(list_distinct(_path)) AS root_h FROM edges WHERE _predicate = '_predicate_enum-of'
),
endpoint_keys AS (
  SELECT substr(_from, 7) AS gid FROM edges UNION SELECT substr(_to, 7) FROM edges UNION SELECT _key FROM terms
)
"""


def with_(body: str, recursive: bool = False, extra: str = "") -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    ctes = DERIVE.strip() + ((",\n" + extra.strip()) if extra else "")
    return head + ctes + "\n" + body.strip()


def resolve_keys_cte(req_sql: str) -> str:
    """``resolved(gid, resolved_gid)`` for distinct ``gid`` of ``req_sql``."""
    return f"""
rk AS (SELECT DISTINCT gid FROM ({req_sql}) WHERE gid IS NOT NULL),
rk_target AS (
  SELECT rk.gid,
         CASE WHEN t._key IS NULL THEN NULL
              WHEN t.is_alias THEN CASE WHEN a.canonical_h LIKE 'terms/%' THEN substr(a.canonical_h, 7) END
              ELSE rk.gid END AS target
  FROM rk LEFT JOIN tflags t ON t._key = rk.gid
          LEFT JOIN alias_map a ON a.shell_h = concat('terms/', rk.gid)
),
resolved AS (
  SELECT r.gid, t2._key AS resolved_gid
  FROM rk_target r LEFT JOIN terms t2 ON t2._key = r.target
)"""


def expand_ctes(req_sql: str, levels: int, direction: str = "inbound") -> str:
    """``best``: the rows of an expansion, each vertex visited once. One CTE per
    hop takes the best edge into each vertex that no earlier hop has visited."""
    near, far = ("_to", "_from") if direction == "inbound" else ("_from", "_to")
    hops = [
        """hop0 AS (
  SELECT DISTINCT request_id, concat('terms/', root) AS root_h, concat('terms/', coalesce(branch, root)) AS vertex, 0 AS level,
         concat('terms/', coalesce(branch, root)) AS anchor, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS predicate,
         false AS is_bridge, 0 AS hops FROM req
)"""
    ]
    for h in range(1, levels + 2):
        seen = " UNION ALL ".join(f"SELECT request_id, vertex FROM hop{k}" for k in range(h))
        hops.append(f"""hop{h} AS (
  SELECT request_id, root_h, vertex, level, anchor, parent, predicate, is_bridge, {h} AS hops FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, vertex ORDER BY is_bridge, level, parent, ekey, anchor, predicate) AS rn FROM (
      SELECT w.request_id, w.root_h, e.far AS vertex, w.level + CASE WHEN e.is_bridge THEN 0 ELSE 1 END AS level,
             CASE WHEN e.is_bridge THEN w.anchor ELSE e.far END AS anchor, w.anchor AS parent, e.predicate, e.is_bridge, e.ekey
      FROM hop{h - 1} w JOIN ebr e ON e.root_h = w.root_h AND e.near = w.vertex
    ) step WHERE NOT EXISTS (SELECT 1 FROM ({seen}) v WHERE v.request_id = step.request_id AND v.vertex = step.vertex)
  ) WHERE rn = 1
)""")
    best = " UNION ALL ".join(f"SELECT * FROM hop{k}" for k in range(1, levels + 2))
    return f"""
req AS ({req_sql}),
ebr AS (
  SELECT root_h, near, far, predicate, ekey, predicate = '_predicate_bridge-of' AS is_bridge FROM (
    SELECT unnest(list_distinct(_path)) AS root_h, {near} AS near, {far} AS far, _predicate AS predicate, _key AS ekey
    FROM edges WHERE _predicate IN ('_predicate_enum-of', '_predicate_section-of', '_predicate_bridge-of')
  )
),
{", ".join(hops)},
best AS ({best})"""


def expand_body(levels: int) -> str:
    return f"""
SELECT CAST(request_id AS BIGINT) AS request_id, substr(vertex, 7) AS gid, predicate, CAST(level AS BIGINT) AS level,
       parent, CAST(hops AS BIGINT) AS hops
FROM best WHERE NOT is_bridge AND level <= {levels}"""


def expand_sql(req_sql: str, levels: int, direction: str = "inbound") -> str:
    return with_(expand_body(levels), extra=expand_ctes(req_sql, levels, direction))


def resolve_sql(req_sql: str, levels: int = 10, predicate: str = "_predicate_enum-of", direction: str = "inbound",
                traverse=("_predicate_section-of", "_predicate_bridge-of")) -> str:
    near, far = ("_to", "_from") if direction == "inbound" else ("_from", "_to")
    allowed = list(traverse) + ([] if predicate in traverse else [predicate])
    allowed_sql = ", ".join(f"'{p}'" for p in allowed)
    extra = f"""
req AS ({req_sql}),
rq AS (SELECT request_id, concat('terms/', root) AS root_h, concat('terms/', target) AS target_h FROM req),
ebr AS (
  SELECT unnest(list_distinct(_path)) AS root_h, {near} AS near, {far} AS far, _predicate = '{predicate}' AS functional
  FROM edges WHERE _predicate IN ({allowed_sql})
),
seed AS (
  SELECT r.request_id, bool_or(e.functional) AS functional
  FROM rq r JOIN ebr e ON e.root_h = r.root_h AND e.far = r.target_h GROUP BY r.request_id
),
walk(request_id, root_h, vertex, hops, path) AS (
  SELECT r.request_id, r.root_h, r.target_h, 0, [r.target_h]
  FROM rq r JOIN seed s ON s.request_id = r.request_id WHERE NOT s.functional
  UNION ALL
  SELECT w.request_id, w.root_h, e.far, w.hops + 1, list_append(w.path, e.far)
  FROM walk w JOIN ebr e ON e.root_h = w.root_h AND e.near = w.vertex
  WHERE w.hops + 1 < {levels} AND NOT e.functional AND NOT list_contains(w.path, e.far)
),
hits AS (
  SELECT w.request_id, w.hops + 1 AS hops, e.far AS canonical_h
  FROM walk w JOIN ebr e ON e.root_h = w.root_h AND e.near = w.vertex
  WHERE e.functional AND NOT list_contains(w.path, e.far)
),
firsthit AS (
  SELECT request_id, hops, canonical_h FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hops, canonical_h) AS rn FROM hits
  ) WHERE rn = 1
),
answer AS (
  SELECT r.request_id,
         s.functional,
         CASE WHEN s.functional THEN r.target_h ELSE f.canonical_h END AS canonical_h,
         CASE WHEN s.functional THEN 0 ELSE f.hops END AS hops
  FROM rq r LEFT JOIN seed s ON s.request_id = r.request_id LEFT JOIN firsthit f ON f.request_id = r.request_id
),
resolved_graph AS (
  SELECT a.request_id, t._key AS resolved_gid,
         CASE WHEN a.functional IS NULL THEN 'not_in_graph'
              WHEN a.canonical_h IS NULL THEN 'unresolved'
              WHEN t._key IS NULL THEN 'not_found' ELSE 'ok' END AS status,
         a.hops
  FROM answer a LEFT JOIN terms t ON concat('terms/', t._key) = a.canonical_h
)"""
    return extra


# Descriptor fields, generically from the JSON text: truthy _open/_closed,
# _required[*]._selection flattened depth-first by a recursive CTE carrying the
# position path, then _recommended, first occurrence wins. Needs
# ``resolve_keys_cte`` (rk, resolved) before it.
FIELDS_CTE = """
fdoc AS (SELECT r.gid, t.doc FROM resolved r JOIN terms t ON t._key = r.resolved_gid),
fobj AS (SELECT gid, json_extract(doc, '$._data._object') AS obj FROM fdoc),
fbody AS (
  SELECT gid, obj,
         CASE WHEN json_type(json_extract(obj, '$._open')) IN ('OBJECT', 'ARRAY') THEN json_extract(obj, '$._open')
              WHEN json_type(json_extract(obj, '$._closed')) IN ('OBJECT', 'ARRAY') THEN json_extract(obj, '$._closed') END AS body
  FROM fobj
),
req_e AS (
  SELECT gid, i, json_extract(json_extract(body, '$._required'), concat('$[', CAST(i AS VARCHAR), ']._selection')) AS v FROM (
    SELECT gid, body, unnest(range(CAST(json_array_length(json_extract(body, '$._required')) AS BIGINT))) AS i
    FROM fbody WHERE json_type(json_extract(body, '$._required')) = 'ARRAY')
),
flat(gid, sp, v) AS (
  SELECT gid, [0, i], v FROM req_e WHERE json_type(v) = 'ARRAY'
  UNION ALL
  SELECT gid, list_append(sp, j), json_extract(v, concat('$[', CAST(j AS VARCHAR), ']')) FROM (
    SELECT gid, sp, v, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS j FROM flat WHERE json_type(v) = 'ARRAY')
),
rec_e AS (
  SELECT gid, [1, j] AS sp, json_extract(json_extract(body, '$._recommended'), concat('$[', CAST(j AS VARCHAR), ']')) AS v FROM (
    SELECT gid, body, unnest(range(CAST(json_array_length(json_extract(body, '$._recommended')) AS BIGINT))) AS j
    FROM fbody WHERE json_type(json_extract(body, '$._recommended')) = 'ARRAY')
),
fields AS (
  SELECT gid, sp, v ->> '$' AS field_gid, true AS required FROM flat WHERE json_type(v) = 'VARCHAR'
  UNION ALL SELECT gid, sp, v ->> '$', false FROM rec_e WHERE json_type(v) = 'VARCHAR'
),
firsts AS (SELECT gid, field_gid, arg_min(required, sp) AS required, min(sp) AS sp FROM fields GROUP BY gid, field_gid),
ordered AS (SELECT gid, field_gid, required, row_number() OVER (PARTITION BY gid ORDER BY sp) AS ord FROM firsts),
fstatus AS (
  SELECT k.gid,
         CASE WHEN r.resolved_gid IS NULL THEN 'not_found'
              WHEN json_type(o.obj) IS NULL OR json_type(o.obj) = 'NULL'
                   OR (json_type(o.obj) = 'BOOLEAN' AND NOT CAST(o.obj AS BOOLEAN))
                   OR (json_type(o.obj) IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND CAST(o.obj AS DOUBLE) = 0)
                   OR (json_type(o.obj) = 'VARCHAR' AND o.obj ->> '$' = '') THEN 'not_object'
              ELSE 'ok' END AS status
  FROM rk k LEFT JOIN resolved r ON r.gid = k.gid LEFT JOIN fobj o ON o.gid = k.gid
)"""
