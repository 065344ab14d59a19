"""Queries: intake, channel, meta merge, sniffing, routing, content types,
HTML sniff, URL predicates, finalize and the union of ingest channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sniff as S
from ..functions import text as T
from ..functions.urls import is_static_url, within_size
from ..sources.intake import intake
from .registry import register
from .sql import q, strip
from .tables import read

# ------------------------------------------------------------ requests

def requests_df(spark, sf_dir):
    """Ingest requests derived from ``events`` (every event is one request)."""
    e = read(spark, sf_dir, "events")
    uid, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    et = F.col("event_type")
    meta = (F.when(et == "view", F.col("props"))
             .when(et == "purchase", F.concat(F.lit('{"filename": "mine_'), eid,
                                              F.lit('.json", "url": " https://p.example/'), uid, F.lit(' "}')))
             .when(et == "click", F.concat(F.lit('{"url": "  https://c.example/'), uid, F.lit("?e="), eid,
                                           F.lit('  "}')))
             .when((et == "signup") & (F.col("value") > 50), F.concat(F.lit("["), F.col("props"), F.lit("]")))
             .when(et == "signup", F.lit('{"url": "   "}'))
             .otherwise(F.col("props")))
    file = (F.when(et == "view", F.encode("props", "UTF-8"))
             .when((et == "purchase") & (F.col("value") >= 50), F.encode("props", "UTF-8"))
             .when(et == "purchase", F.lit(b"").cast("binary")))
    return e.select(
        "event_id",
        F.when(et == "error", F.lit(" \t ")).otherwise(F.concat(F.lit(" user/"), uid, F.lit(" "))).alias("source"),
        F.concat(F.lit("ev/"), eid).alias("source_id"),
        file.alias("file"),
        F.when(et.isin("view", "purchase"), F.concat(F.lit(" up_"), eid, F.lit(".json "))).alias("filename"),
        meta.alias("meta"),
        F.when(et == "click", F.floor(F.col("value") * 1000).cast("int")).alias("max_age"))


REQUESTS_CTE = """
req AS (SELECT event_id,
  CASE WHEN event_type = 'error' THEN ' ' || chr(9) || ' ' ELSE ' user/' || user_id || ' ' END AS source,
  'ev/' || event_id AS source_id,
  CASE WHEN event_type = 'view' THEN encode(props)
       WHEN event_type = 'purchase' AND value >= 50 THEN encode(props)
       WHEN event_type = 'purchase' THEN ''::BLOB END AS file,
  CASE WHEN event_type IN ('view', 'purchase') THEN ' up_' || event_id || '.json ' END AS filename,
  CASE WHEN event_type = 'view' THEN props
       WHEN event_type = 'purchase' THEN '{"filename": "mine_' || event_id || '.json", "url": " https://p.example/' || user_id || ' "}'
       WHEN event_type = 'click' THEN '{"url": "  https://c.example/' || user_id || '?e=' || event_id || '  "}'
       WHEN event_type = 'signup' AND value > 50 THEN '[' || props || ']'
       WHEN event_type = 'signup' THEN '{"url": "   "}'
       ELSE props END AS meta,
  CASE WHEN event_type = 'click' THEN CAST(floor(value * 1000) AS INTEGER) END AS max_age
FROM events)"""

INTAKE_SQL = f"""
WITH {REQUESTS_CTE.strip()},
c AS (SELECT *, nullif({strip('source')}, '') AS s, nullif({strip('source_id')}, '') AS sid,
   coalesce(json_valid(meta) AND json_type(meta) = 'OBJECT', false) AS ok_meta,
   coalesce(octet_length(file), 0) > 0 AS has_file FROM req),
m AS (SELECT *, CASE WHEN ok_meta THEN json_extract_string(meta, '$.url') END AS raw_url,
   CASE WHEN ok_meta THEN coalesce(json_extract_string(meta, '$.filename'),
        CASE WHEN file IS NOT NULL AND {strip('filename')} <> '' THEN {strip('filename')} END) END AS fname FROM c),
u AS (SELECT *, CASE WHEN raw_url IS NOT NULL AND raw_url <> '' THEN {strip('raw_url')} END AS url0 FROM m),
r AS (SELECT *, CASE WHEN s IS NULL OR sid IS NULL THEN 'source and source_id required'
                    WHEN NOT ok_meta THEN 'meta must be a valid JSON object'
                    WHEN NOT has_file AND coalesce(url0 = '', true) THEN 'file or url required' END AS reject_reason
      FROM u)
SELECT event_id, s AS source, sid AS source_id, reject_reason,
  CASE WHEN reject_reason IS NULL THEN CASE WHEN has_file THEN 'file' ELSE 'url' END END AS channel,
  fname AS filename,
  CASE WHEN reject_reason IS NULL AND NOT has_file THEN url0 END AS url,
  CASE WHEN reject_reason IS NULL AND has_file THEN sha256(file) END AS sha256,
  CAST(coalesce(max_age, 86400) AS BIGINT) AS max_age
FROM r"""


@register("src_3_intake", INTAKE_SQL)
def src_3_intake(spark, sf_dir):
    """Request validation: trimmed source/source_id, JSON-object meta, upload
    filename unless the client meta names one, trimmed or dropped url, file or
    url required, default max_age; file-vs-url channel and content hash."""
    c = intake(requests_df(spark, sf_dir))
    return c.select("event_id", F.col("clean_source").alias("source"), F.col("clean_source_id").alias("source_id"),
                    "reject_reason", "channel", F.col("clean_filename").alias("filename"), "url", "sha256",
                    F.col("clean_max_age").cast("bigint").alias("max_age"))


@register("src_4_channel", f"""
WITH i AS ({INTAKE_SQL})
SELECT coalesce(channel, 'rejected') AS channel, coalesce(reject_reason, '') AS reason, count(*) AS n
FROM i GROUP BY 1, 2""")
def src_4_channel(spark, sf_dir):
    """Requests per channel (file wins over url) and per reject reason."""
    c = intake(requests_df(spark, sf_dir))
    return (c.groupBy(F.coalesce("channel", F.lit("rejected")).alias("channel"),
                      F.coalesce("reject_reason", F.lit("")).alias("reason"))
             .agg(F.count(F.lit(1)).alias("n")))


@register("meta_1_merge", """
SELECT event_id,
  CASE WHEN event_type = 'purchase' THEN 'mine_' || event_id || '.json' ELSE 'up_' || event_id || '.json' END AS filename,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_type IN ('view', 'purchase')""")
def meta_1_merge(spark, sf_dir):
    """Meta merge, right side wins: upload name merged under client meta."""
    from ..sources.intake import merge_meta
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "purchase"))
    eid = F.col("event_id").cast("string")
    client = F.from_json(F.when(F.col("event_type") == "purchase",
                                F.concat(F.lit('{"filename": "mine_'), eid, F.lit('.json", "k": '),
                                         F.get_json_object("props", "$.k"), F.lit("}")))
                          .otherwise(F.col("props")), "map<string,string>")
    up = F.create_map(F.lit("filename"), F.concat(F.lit("up_"), eid, F.lit(".json")))
    m = merge_meta(up, client)
    return e.select("event_id", m["filename"].alias("filename"), m["k"].cast("bigint").alias("k"))


@register("meta_2_json", """
SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k_mod, count(*) AS n,
       round(sum(value), 6) AS total
FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 GROUP BY 1, 2""")
def meta_2_json(spark, sf_dir):
    """Meta access and filter on a JSON key (events.props.k)."""
    e = read(spark, sf_dir, "events")
    k = F.variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return (e.filter(k >= 50).groupBy("event_type", (k % 10).alias("k_mod"))
             .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")))


# ---------------------------------------------------------------- blobs

def blobs_df(spark, sf_dir):
    """A mixed blob table from the driver tables: document texts, web pages,
    PNG headers (part), PDF stubs (orders), CSV files (nations per region),
    JSON documents (customers), NDJSON files (suppliers per nation)."""
    d = read(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"),
                                                F.encode("text", "UTF-8").alias("content"))
    p = read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                                            F.encode("html", "UTF-8").alias("content"))
    pt = read(spark, sf_dir, "part").select(
        F.lit("png").alias("kind"), F.col("p_partkey").alias("id"),
        F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"),
                         F.lpad(F.hex(F.col("p_size")), 8, "0"),
                         F.lpad(F.hex(F.col("p_partkey") % 4096), 8, "0"))).alias("content"))
    o = read(spark, sf_dir, "orders").select(
        F.lit("pdf").alias("kind"), F.col("o_orderkey").alias("id"),
        F.encode(F.concat(F.lit("%PDF-1.7\n% order "), F.col("o_orderkey").cast("string")), "UTF-8").alias("content"))
    n = read(spark, sf_dir, "nation")
    csv = (n.groupBy("n_regionkey")
            .agg(F.listagg(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name",
                                       F.col("n_regionkey").cast("string")), "\n").alias("t"))
            .select(F.lit("csv").alias("kind"), F.col("n_regionkey").cast("bigint").alias("id"),
                    F.encode(F.concat(F.lit("key,name,region\n"), "t"), "UTF-8").alias("content")))
    c = read(spark, sf_dir, "customer").select(
        F.lit("json").alias("kind"), F.col("c_custkey").alias("id"),
        F.encode(F.concat(F.lit('{"key": '), F.col("c_custkey").cast("string"), F.lit(', "name": "'),
                          F.col("c_name"), F.lit('"}')), "UTF-8").alias("content"))
    s = read(spark, sf_dir, "supplier")
    # one NDJSON file per nation and block of 100 supplier keys (bounded files)
    nd = (s.groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 100).alias("blk"))
           .agg(F.listagg(F.concat(F.lit('{"key": '), F.col("s_suppkey").cast("string"), F.lit("}")), "\n")
                .alias("t"))
           .select(F.lit("ndjson").alias("kind"), (F.col("s_nationkey") * 1000000 + F.col("blk")).cast("bigint").alias("id"),
                   F.encode("t", "UTF-8").alias("content")))
    return d.unionByName(p).unionByName(pt).unionByName(o).unionByName(csv).unionByName(c).unionByName(nd)


BLOBS_CTE = """
blobs AS (
  SELECT 'doc' AS kind, doc_id AS id, text AS t, NULL::BLOB AS b FROM documents
  UNION ALL SELECT 'page', page_id, html, NULL FROM pages
  UNION ALL SELECT 'png', p_partkey, NULL, unhex('89504E470D0A1A0A0000000D49484452' || lpad(hex(p_size), 8, '0') || lpad(hex(p_partkey % 4096), 8, '0')) FROM part
  UNION ALL SELECT 'pdf', o_orderkey, '%PDF-1.7' || chr(10) || '% order ' || o_orderkey, NULL FROM orders
  UNION ALL SELECT 'csv', n_regionkey, 'key,name,region' || chr(10) || string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey, chr(10)), NULL FROM nation GROUP BY n_regionkey
  UNION ALL SELECT 'json', c_custkey, '{"key": ' || c_custkey || ', "name": "' || c_name || '"}', NULL FROM customer
  UNION ALL SELECT 'ndjson', CAST(s_nationkey * 1000000 + floor(s_suppkey / 100) AS BIGINT), string_agg('{"key": ' || s_suppkey || '}', chr(10)), NULL
            FROM supplier GROUP BY s_nationkey, floor(s_suppkey / 100))"""

WS = T.WS
ROUTE_SQL = f"""
WITH {BLOBS_CTE.strip()},
x AS (SELECT kind, id, t, b,
   list_filter(string_split(coalesce(t, ''), chr(10)), lambda l: trim(l) <> '') AS lines FROM blobs),
y AS (SELECT *,
   CASE WHEN b IS NOT NULL AND hex(b[1:8]) = '89504E470D0A1A0A' THEN 'image'
        WHEN t IS NOT NULL AND starts_with(t, '%PDF') THEN 'pdf'
        WHEN t IS NOT NULL AND json_valid(t) AND regexp_matches(t, '^[{WS}]*[\\[{{]') THEN 'json'
        WHEN len(lines) >= 1 AND list_bool_and(list_transform(lines, lambda l: json_valid(l) AND starts_with(ltrim(l), '{{'))) THEN 'ndjson'
        WHEN len(lines) >= 5 AND (
             (list_min(list_transform(lines, lambda l: length(l) - length(replace(l, ',', '')))) >= 1 AND
              list_min(list_transform(lines, lambda l: length(l) - length(replace(l, ',', '')))) =
              list_max(list_transform(lines, lambda l: length(l) - length(replace(l, ',', '')))))
          OR (list_min(list_transform(lines, lambda l: length(l) - length(replace(l, ';', '')))) >= 1 AND
              list_min(list_transform(lines, lambda l: length(l) - length(replace(l, ';', '')))) =
              list_max(list_transform(lines, lambda l: length(l) - length(replace(l, ';', '')))))
          OR (list_min(list_transform(lines, lambda l: length(l) - length(replace(l, chr(9), '')))) >= 1 AND
              list_min(list_transform(lines, lambda l: length(l) - length(replace(l, chr(9), '')))) =
              list_max(list_transform(lines, lambda l: length(l) - length(replace(l, chr(9), '')))))
          OR (list_min(list_transform(lines, lambda l: length(l) - length(replace(l, '|', '')))) >= 1 AND
              list_min(list_transform(lines, lambda l: length(l) - length(replace(l, '|', '')))) =
              list_max(list_transform(lines, lambda l: length(l) - length(replace(l, '|', '')))))) THEN 'csv'
        WHEN regexp_matches(left(regexp_replace(left(t, 10000), '[{WS}]+', ' ', 'g'), 100), '(?i)<(!doctype|html)\\b') THEN 'html'
        ELSE 'markdown' END AS route
   FROM x)"""


@register("flt_2_route", ROUTE_SQL + """
SELECT kind, id, route,
  CASE route WHEN 'image' THEN 'image/png' WHEN 'pdf' THEN 'application/pdf' WHEN 'json' THEN 'application/json'
    WHEN 'ndjson' THEN 'application/json' WHEN 'csv' THEN 'text/csv' WHEN 'html' THEN 'text/html'
    ELSE 'text/markdown' END AS content_type
FROM y""")
def flt_2_route(spark, sf_dir):
    """Format routing of a mixed blob table (magic bytes, JSON, NDJSON, CSV
    dialect, HTML document sniff, markdown fallback) and the content type."""
    b = S.with_route(blobs_df(spark, sf_dir), "content", "route", kind_out="k")
    return b.select("kind", "id", "route", S.content_type(F.col("route"), F.col("k")).alias("content_type"))


@register("meta_7_content_types", ROUTE_SQL + """
SELECT kind, route, count(*) AS n FROM y GROUP BY 1, 2""")
def meta_7_content_types(spark, sf_dir):
    """Blob counts per origin and route."""
    b = S.with_route(blobs_df(spark, sf_dir), "content", "route")
    return b.groupBy("kind", "route").agg(F.count(F.lit(1)).alias("n"))


@register("flt_1_sniff", """
WITH b AS (SELECT p_partkey AS id, p_size,
   unhex('89504E470D0A1A0A0000000D49484452' || lpad(hex(p_size), 8, '0') || lpad(hex(p_partkey % 4096), 8, '0')) AS content FROM part)
SELECT id, 'png' AS kind, CAST(p_size AS BIGINT) AS width, CAST(id % 4096 AS BIGINT) AS height FROM b""")
def flt_1_sniff(spark, sf_dir):
    """Magic-byte sniff and PNG header dimensions from bytes."""
    from ..operators.enrich import image_profile
    p = read(spark, sf_dir, "part")
    content = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(F.col("p_size")), 8, "0"),
                               F.lpad(F.hex(F.col("p_partkey") % 4096), 8, "0")))
    prof = image_profile(content)
    return p.select(F.col("p_partkey").alias("id"), S.sniff_kind(content).alias("kind"),
                    prof["width"].cast("bigint").alias("width"), prof["height"].cast("bigint").alias("height"))


@register("flt_3_html_sniff", f"""
WITH h AS (SELECT page_id AS id, html AS t FROM pages
           UNION ALL SELECT doc_id + 1000000000, '<p>' || text || '</p>' FROM documents
           UNION ALL SELECT doc_id + 2000000000, chr(10) || '  <HTML lang=x>' || text FROM documents)
SELECT id, regexp_matches(left(regexp_replace(left(t, 10000), '[{WS}]+', ' ', 'g'), 100), '(?i)<(!doctype|html)\\b') AS is_document
FROM h""")
def flt_3_html_sniff(spark, sf_dir):
    """HTML document vs fragment sniff on pages, fragments and upper-case tags."""
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("t"))
    d = read(spark, sf_dir, "documents")
    f1 = d.select((F.col("doc_id") + 1000000000).alias("id"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("t"))
    f2 = d.select((F.col("doc_id") + 2000000000).alias("id"), F.concat(F.lit("\n  <HTML lang=x>"), "text").alias("t"))
    return p.unionByName(f1).unionByName(f2).select("id", S.html_doc_sniff(F.col("t")).alias("is_document"))


# -------------------------------------------------------------- URL guards

@register("flt_5_static", f"""
SELECT page_id, url,
  regexp_matches(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)),
    '\\.(pdf|jpg|jpeg|png|gif|webp|svg|doc|docx|ppt|pptx|xls|xlsx|ods|odp|odt|csv|txt|md|zip|tar|gz)$') AS is_static
FROM (SELECT page_id, url FROM pages
      UNION ALL SELECT page_id + 1000000, regexp_replace(url, '^([^?#]*)', '\\1/f' || page_id || '.PDF') FROM pages)""")
def flt_5_static(spark, sf_dir):
    """Static-file URL test: lower-cased path ends with a known file extension."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    v = p.select((F.col("page_id") + 1000000).alias("page_id"),
                 F.regexp_replace("url", "^([^?#]*)", F.concat(F.lit("$1/f"), F.col("page_id").cast("string"),
                                                                F.lit(".PDF"))).alias("url"))
    u = p.unionByName(v)
    return u.select("page_id", "url", is_static_url(F.col("url")).alias("is_static"))


@register("flt_6_size_guard", f"""
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes,
  octet_length(encode(html)) <= 8192 AS within_limit,
  regexp_matches(CAST(page_id * 977 AS VARCHAR), '^[0-9]+$') AND page_id * 977 <= 8192 AS declared_ok
FROM pages""")
def flt_6_size_guard(spark, sf_dir):
    """Size guard on body bytes and on a declared numeric content-length
    (limit lowered to 8 KiB so the test data has both outcomes)."""
    p = read(spark, sf_dir, "pages")
    n = F.octet_length(F.encode("html", "UTF-8"))
    declared = (F.col("page_id") * 977).cast("string")
    return p.select("page_id", n.cast("bigint").alias("n_bytes"), within_size(n, 8192).alias("within_limit"),
                    within_size(declared, 8192).alias("declared_ok"))


# ------------------------------------------------------------- finalize

@register("src_12_finalize", f"""
WITH m AS (SELECT doc_id, {__import__('quarry.plans.q_text', fromlist=['x']).WITH_URLS_SQL} AS md FROM documents),
f AS (SELECT sha256(md) AS sha256, any_value({__import__('quarry.plans.q_text', fromlist=['x']).LINKIFY_SQL}) AS markdown
      FROM m GROUP BY 1)
SELECT sha256, sha256(markdown) AS markdown_sha256,
  CAST(len(regexp_extract_all(markdown, {q(T.MD_LINK_RE)}, 2)) AS BIGINT) AS n_links,
  'text/markdown' AS content_type
FROM f""")
def src_12_finalize(spark, sf_dir):
    """Finalize: linkify, link list into meta, content type; one file row per hash."""
    from .q_text import _with_urls
    d = read(spark, sf_dir, "documents")
    src = d.select(_with_urls().alias("md"))
    files = src.groupBy(T.content_sha256(F.col("md")).alias("sha256")).agg(F.any_value("md").alias("md"))
    md = T.linkify(F.col("md"))
    return files.select("sha256", T.content_sha256(md).alias("markdown_sha256"),
                        F.size(T.extract_links(md)).cast("bigint").alias("n_links"),
                        F.lit("text/markdown").alias("content_type"))


@register("set_1_union", """
SELECT channel, count(*) AS n, count(DISTINCT sha) AS n_distinct FROM (
  SELECT 'upload' AS channel, sha256(text) AS sha FROM documents
  UNION ALL SELECT 'url', sha256(html) FROM pages
  UNION ALL SELECT 'member', sha256(text) FROM conversations
  UNION ALL SELECT 'image', sha256(encode(text)) FROM benchmark) GROUP BY 1""")
def set_1_union(spark, sf_dir):
    """Union of ingest channels (uploads, URL fetches, archive members, images)."""
    u = read(spark, sf_dir, "documents").select(F.lit("upload").alias("channel"), T.content_sha256(F.col("text")).alias("sha"))
    p = read(spark, sf_dir, "pages").select(F.lit("url").alias("channel"), T.content_sha256(F.col("html")).alias("sha"))
    m = read(spark, sf_dir, "conversations").select(F.lit("member").alias("channel"), T.content_sha256(F.col("text")).alias("sha"))
    i = read(spark, sf_dir, "benchmark").select(F.lit("image").alias("channel"),
                                                 T.content_sha256(F.encode("text", "UTF-8")).alias("sha"))
    return (u.unionByName(p).unionByName(m).unionByName(i)
             .groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sha").alias("n_distinct")))



@register("flt_7_fetch_log", """
WITH log AS (SELECT event_id, 'https://p.example/' || user_id AS url,
    CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' AND value > 90 THEN 404 ELSE 200 END AS status,
    CASE WHEN event_type = 'purchase' THEN CAST(CAST(value * 1000000 AS BIGINT) AS VARCHAR) ELSE '' END AS content_length,
    props AS body FROM events)
SELECT event_id, url, status FROM log
WHERE status BETWEEN 200 AND 299 AND body IS NOT NULL
  AND (content_length = '' OR NOT regexp_matches(content_length, '^[0-9]+$') OR CAST(content_length AS DECIMAL(38,0)) <= 50000000)""")
def flt_7_fetch_log(spark, sf_dir):
    """Fetch-log filter: keep successful responses with a body whose declared
    numeric content length is within the size limit (50 MB here)."""
    e = read(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "error", 500)
               .when((F.col("event_type") == "signup") & (F.col("value") > 90), 404).otherwise(200))
    cl = F.when(F.col("event_type") == "purchase",
                (F.col("value") * 1000000).cast("decimal(38,6)").cast("bigint").cast("string")).otherwise(F.lit(""))
    log = e.select("event_id", F.concat(F.lit("https://p.example/"), F.col("user_id").cast("string")).alias("url"),
                   status.alias("status"), cl.alias("content_length"), F.col("props").alias("body"))
    ok = (F.col("status").between(200, 299) & F.col("body").isNotNull()
          & ((F.col("content_length") == "") | ~F.col("content_length").rlike("^[0-9]+$")
             | within_size(F.col("content_length"), 50000000)))
    return log.filter(ok).select("event_id", "url", "status")
