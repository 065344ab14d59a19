"""Queries: text normalization, linkify, link extraction, markdown refs,
data-URI images, base64, image-response sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import register
from .sql import q, strip
from .tables import read

WS = T.WS

# ---------------------------------------------------------------- STR-1


@register("str_1_normalize", f"""
SELECT doc_id,
  sha256(replace(CASE WHEN lang = 'en' THEN text
                      ELSE regexp_replace(text, '[^\\x{{0}}-\\x{{ff}}]', '?', 'g') END, chr(13), chr(10))) AS sha256,
  CAST(length(CASE WHEN lang = 'en' THEN text
                   ELSE regexp_replace(text, '[^\\x{{0}}-\\x{{ff}}]', '?', 'g') END) AS BIGINT) AS n_chars
FROM documents""")
def str_1_normalize(spark, sf_dir):
    """Bytes → UTF-8 text: English docs as UTF-8 with CRLF line ends, the others
    as latin-1 with CR line ends; both come back as LF-terminated UTF-8."""
    d = read(spark, sf_dir, "documents")
    latin = F.regexp_replace("text", "[^\\x{0}-\\x{ff}]", "?")
    raw = F.when(F.col("lang") == "en", F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8")) \
           .otherwise(F.encode(F.replace(latin, F.lit("\n"), F.lit("\r")), "ISO-8859-1"))
    norm = T.normalize_text(raw)
    return d.select("doc_id", T.content_sha256(norm).alias("sha256"), F.length(norm).cast("bigint").alias("n_chars"))


# ------------------------------------------------------------ STR-2 / STR-3

def _with_urls(col_text="text"):
    """Markdown with bare URLs, wrapped links, quoted and parenthesised URLs."""
    did = F.col("doc_id").cast("string")
    return F.concat(F.col(col_text), F.lit(" see https://"), F.col("source"), F.lit(".example.com/d/"), did,
                    F.lit(". [ref](https://x.org/"), did, F.lit(") \"http://q.example/"), F.col("lang"),
                    F.lit("\" (HTTP://P.EXAMPLE/"), did, F.lit(") [https://a.example/"), did,
                    F.lit("](https://a.example/"), did, F.lit(")"))


WITH_URLS_SQL = ("text || ' see https://' || source || '.example.com/d/' || doc_id || '. [ref](https://x.org/' || doc_id"
                 " || ') \"http://q.example/' || lang || '\" (HTTP://P.EXAMPLE/' || doc_id || ') [https://a.example/'"
                 " || doc_id || '](https://a.example/' || doc_id || ')'")
# RE2 has no look-behind: "not after '(' or '\"'" becomes a consumed
# preceding character (or start of text) that is written back.
LINKIFY_SQL = f"regexp_replace(md, '(^|[^(\"])(https?://[^{WS})\\]>\"]+)', '\\1[\\2](\\2)', 'gi')"
LINK_RE_SQL = q(T.MD_LINK_RE)


@register("str_2_linkify", f"""
WITH m AS (SELECT doc_id, {WITH_URLS_SQL} AS md FROM documents),
l AS (SELECT doc_id, {LINKIFY_SQL} AS md FROM m)
SELECT doc_id, sha256(md) AS sha256, CAST(length(md) AS BIGINT) AS n_chars,
       CAST(len(regexp_extract_all(md, {LINK_RE_SQL}, 2)) AS BIGINT) AS n_links
FROM l""")
def str_2_linkify(spark, sf_dir):
    """Linkify bare URLs (not after '(' , '](' or '\"'), count links afterwards."""
    d = read(spark, sf_dir, "documents")
    md = T.linkify(_with_urls())
    return d.select("doc_id", T.content_sha256(md).alias("sha256"), F.length(md).cast("bigint").alias("n_chars"),
                    F.size(T.extract_links(md)).cast("bigint").alias("n_links"))


@register("agg_3_links", f"""
WITH m AS (SELECT doc_id, {WITH_URLS_SQL} AS md FROM documents),
l AS (SELECT doc_id, regexp_extract_all({LINKIFY_SQL}, {LINK_RE_SQL}, 2) AS links FROM m)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, links[i] AS url
FROM (SELECT doc_id, links, generate_subscripts(links, 1) AS i FROM l)""")
def agg_3_links(spark, sf_dir):
    """Ordered link list per file after linkify (duplicates kept), as rows."""
    d = read(spark, sf_dir, "documents")
    links = T.extract_links(T.linkify(_with_urls()))
    return (d.select("doc_id", F.posexplode_outer(links).alias("pos", "url")).filter(F.col("pos").isNotNull())
             .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "url"))


# ---------------------------------------------------------------- STR-6

def _with_refs():
    did = F.col("doc_id").cast("string")
    return F.concat(F.lit("![p"), did, F.lit("](img"), did, F.lit(".png) "), F.col("text"),
                    F.lit(" [t](rel/"), did, F.lit(") ![abs](https://img.example/"), F.col("lang"),
                    F.lit(".jpg) ![h]("), F.sha2(F.col("text"), 256), F.lit(") ![x](http://img.example/"),
                    did, F.lit(".gif) [](u3)"))


WITH_REFS_SQL = ("'![p' || doc_id || '](img' || doc_id || '.png) ' || text || ' [t](rel/' || doc_id || ') "
                 "![abs](https://img.example/' || lang || '.jpg) ![h](' || sha256(text) || ') ![x](http://img.example/'"
                 " || doc_id || '.gif) [](u3)'")
REF_ALL_SQL = q(r"(!?\[[^\]]*\]\([^)]+\))")


@register("str_6_md_refs", f"""
WITH m AS (SELECT doc_id, {WITH_REFS_SQL} AS md FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(md, {REF_ALL_SQL}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM m),
r AS (SELECT doc_id,
   array_to_string(list_transform(parts, lambda x, i: CASE WHEN i % 2 = 0 AND starts_with(x, '![')
        AND NOT regexp_matches(regexp_extract(x, '\\]\\(([^)]+)\\)$', 1), '^(https?://|[a-f0-9]{{64}}\\n?$)')
        THEN '' ELSE x END), '') AS md,
   list_distinct(list_filter(list_transform(list_filter(parts, lambda x, i: i % 2 = 0 AND starts_with(x, '![')),
        lambda x: regexp_extract(x, '\\]\\(([^)]+)\\)$', 1)), lambda t: regexp_matches(t, '^https?://'))) AS imgs
 FROM p)
SELECT doc_id, sha256(md) AS sha256, CAST(length(md) AS BIGINT) AS n_chars, CAST(len(imgs) AS BIGINT) AS n_images
FROM r""")
def str_6_md_refs(spark, sf_dir):
    """Markdown reference resolve without base URL: relative images dropped,
    relative links kept, absolute and content-hash refs kept; image set counted."""
    d = read(spark, sf_dir, "documents")
    src = _with_refs()
    md = T.resolve_markdown_refs(src)
    return d.select("doc_id", T.content_sha256(md).alias("sha256"), F.length(md).cast("bigint").alias("n_chars"),
                    F.size(T.markdown_images(src)).cast("bigint").alias("n_images"))


@register("str_6_base", """
SELECT doc_id, '![a](https://b.example/dir/img/' || doc_id || '.png) [t](https://b.example/up/' || doc_id || ') [q](https://b.example/dir/page?q=' || doc_id
  || ') [h](https://x.example/' || doc_id || ') ![c](' || sha256(text) || ') [r](https://b.example/root' || doc_id || ') [n](https://cdn.example/' || doc_id || ')' AS md FROM documents""")
def str_6_base(spark, sf_dir):
    """Markdown references joined to a base URL: relative, parent, query, root and
    network paths; absolute and content-hash refs stay."""
    i = F.col("doc_id").cast("string")
    md = F.concat(F.lit("![a](img/"), i, F.lit(".png) [t](../up/"), i, F.lit(") [q](?q="), i, F.lit(") [h](https://x.example/"), i, F.lit(") ![c]("), F.sha2("text", 256),
                  F.lit(") [r](/root"), i, F.lit(") [n](//cdn.example/"), i, F.lit(")"))
    d = read(spark, sf_dir, "documents").select("doc_id", md.alias("md"))
    return d.select("doc_id", T.resolve_markdown_refs(F.col("md"), F.lit("https://b.example/dir/page")).alias("md"))


# ---------------------------------------------------------------- STR-8

def _with_data_uri():
    b64 = T.encode_b64(F.encode("text", "UTF-8"))
    return F.concat(F.lit("<p>"), F.col("lang"), F.lit("</p><img src=\"data:image/png;base64,"), b64,
                    F.lit("\"><img SRC = 'data:image/gif;base64,@@'>"))


@register("str_8_data_uri", """
SELECT doc_id, sha256(encode(text)) AS image_sha256, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
       sha256('<p>' || lang || '</p><img src="' || sha256(encode(text)) || '"><img SRC = ''' || sha256('') || '''>') AS html_sha256
FROM documents""")
def str_8_data_uri(spark, sf_dir):
    """Data-URI images: payload decoded (non-validating base64, so '@@' is the
    empty image) and hashed (child file), the attribute rewritten to the hash
    reference; payloads with incomplete quads stay."""
    # page and image are projected once, what reads them comes after
    d = read(spark, sf_dir, "documents").select("doc_id", _with_data_uri().alias("html"))
    d = d.select("doc_id", "html", T.decode_b64_lenient(T.data_uri_payloads(F.col("html"))[0]).alias("raw"))
    return d.select("doc_id", F.sha2("raw", 256).alias("image_sha256"),
                    F.octet_length("raw").cast("bigint").alias("n_bytes"),
                    F.sha2(T.replace_data_uris(F.col("html")), 256).alias("html_sha256"))


@register("meta_4_base64", """
SELECT doc_id, CAST(length(to_base64(encode(text))) AS BIGINT) AS b64_len,
       from_base64(to_base64(encode(text))) = encode(text) AS round_trip
FROM documents""")
def meta_4_base64(spark, sf_dir):
    """Base64 encode / decode round trip of every document's bytes."""
    d = read(spark, sf_dir, "documents")
    b = F.encode("text", "UTF-8")
    e = T.encode_b64(b)
    return d.select("doc_id", F.length(e).cast("bigint").alias("b64_len"), (T.decode_b64(e) == b).alias("round_trip"))


# ---------------------------------------------------------------- STR-13

@register("str_13_ocr_desc", f"""
WITH r AS (SELECT item_id, 'OCR:' || chr(10) || text || chr(10) || chr(10) || 'DESC:' || chr(10) || replace(text, ' ', '_') AS resp FROM benchmark)
SELECT item_id, {strip("regexp_extract(resp, '(?s)OCR:(.*?)(?:\\nDESC:|$)', 1)")} AS ocr,
       {strip("regexp_extract(resp, '(?s)\\nDESC:(.*)$', 1)")} AS description
FROM r""")
def str_13_ocr_desc(spark, sf_dir):
    """Split image-model responses into OCR text and description."""
    b = read(spark, sf_dir, "benchmark")
    resp = F.concat(F.lit("OCR:\n"), F.col("text"), F.lit("\n\nDESC:\n"), F.replace("text", F.lit(" "), F.lit("_")))
    return b.select("item_id", T.ocr_section(resp).alias("ocr"), T.desc_section(resp).alias("description"))


@register("str_3_links", f"""
WITH m AS (SELECT doc_id, {WITH_REFS_SQL} AS md FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(md, {LINK_RE_SQL}, 2)) AS BIGINT) AS n_links,
       regexp_extract_all(md, {LINK_RE_SQL}, 2)[1] AS first_link,
       regexp_extract_all(md, {LINK_RE_SQL}, 2)[-1] AS last_link
FROM m""")
def str_3_links(spark, sf_dir):
    """Link targets of markdown links and images, in order (images included)."""
    d = read(spark, sf_dir, "documents")
    links = T.extract_links(_with_refs())
    return d.select("doc_id", F.size(links).cast("bigint").alias("n_links"),
                    F.try_element_at(links, F.lit(1)).alias("first_link"),
                    F.try_element_at(links, F.lit(-1)).alias("last_link"))
