"""Queries: converter contract over text routes, embedder contract, image
text requests / responses, image header profiles and office properties."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.text import content_sha256
from ..operators import enrich as EN
from ..operators.ingest import convert_files
from ..operators.search import hash_embed
from ..sources import archives as A
from .registry import register
from .tables import read


def _udf1_sql():
    from .q_html import _sql_markdown
    from .q_text import LINKIFY_SQL, REF_ALL_SQL
    from ..functions.text import WS
    comma = lambda d: f"list_transform(lines, lambda l: length(l) - length(replace(l, {d}, '')))"
    consistent = " OR ".join(f"(list_min({comma(d)}) >= 1 AND list_min({comma(d)}) = list_max({comma(d)}))"
                             for d in ["','", "';'", "chr(9)", "'|'"])
    resolve = ("array_to_string(list_transform(parts, lambda x, i: CASE WHEN i % 2 = 0 AND starts_with(x, '![') "
               "AND NOT regexp_matches(regexp_extract(x, '\\]\\(([^)]+)\\)$', 1), '^(https?://|[a-f0-9]{64}\\n?$)') "
               "THEN '' ELSE x END), '')")
    imgs = ("list_distinct(list_filter(list_transform(list_filter(parts, lambda x, i: i % 2 = 0 AND starts_with(x, '![')), "
            "lambda x: regexp_extract(x, '\\]\\(([^)]+)\\)$', 1)), lambda t: regexp_matches(t, '^https?://')))")
    return f"""
WITH src AS (SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT page_id, html FROM pages),
x AS (SELECT id, t, list_filter(string_split(t, chr(10)), lambda l: trim(l) <> '') AS lines FROM src),
y AS (SELECT id, t, CASE
        WHEN json_valid(t) AND regexp_matches(t, '^[{WS}]*[\\[{{]') THEN 'json'
        WHEN len(lines) >= 1 AND list_bool_and(list_transform(lines, lambda l: json_valid(l) AND starts_with(ltrim(l), '{{'))) THEN 'ndjson'
        WHEN len(lines) >= 5 AND ({consistent}) THEN 'csv'
        WHEN regexp_matches(left(regexp_replace(left(t, 10000), '[{WS}]+', ' ', 'g'), 100), '(?i)<(!doctype|html)\\b') THEN 'html'
        ELSE 'markdown' END AS route FROM x),
h AS (SELECT id, route, CASE WHEN route = 'html' THEN {_sql_markdown('t', True)}
                             WHEN route = 'markdown' THEN {_sql_markdown('t', False)} END AS h FROM y),
p AS (SELECT id, route, h, string_split(regexp_replace(h, {REF_ALL_SQL}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM h),
r AS (SELECT id, route, CASE WHEN h IS NOT NULL THEN {resolve} END AS md, {imgs} AS imgs FROM p)
SELECT id, route, sha256({LINKIFY_SQL}) AS sha256,
  CASE route WHEN 'html' THEN 'text/html' WHEN 'markdown' THEN 'text/markdown' WHEN 'csv' THEN 'text/csv'
             ELSE 'application/json' END AS content_type,
  CAST(coalesce(len(imgs), 0) AS BIGINT) AS n_images
FROM r"""


@register("udf_1_convert", _udf1_sql())
def udf_1_convert(spark, sf_dir):
    """Converter contract: route every text blob (documents, pages) and convert
    it to markdown, image URLs and meta."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("content"))
    blobs = d.unionByName(p).select("id", F.sha2("content", 256).alias("sha256"), "content")
    c = convert_files(blobs.dropDuplicates(["sha256"]))
    done = c.select("sha256", "route", F.sha2("markdown", 256).alias("md"), F.col("meta")["content_type"].alias("content_type"),
                    F.size("image_urls").cast("bigint").alias("n_images"))
    return blobs.select("id", "sha256").join(done, "sha256").select("id", "route", F.col("md").alias("sha256"), "content_type", "n_images")


@register("udf_2_embed", """
WITH f AS (SELECT DISTINCT text FROM documents)
SELECT sha256(text) AS sha256, 64::BIGINT AS dim,
       CAST(CASE WHEN len(regexp_extract_all(lower(text), '[\\pL\\pN]+')) > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS norm
FROM f""")
def udf_2_embed(spark, sf_dir):
    """Embedder contract: deterministic 64-d vectors, unit norm (zero for texts
    without words), one per distinct document."""
    d = read(spark, sf_dir, "documents").select("text").distinct()
    v = d.select(content_sha256(F.col("text")).alias("sha256"), hash_embed(F.col("text")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("sha256", F.size("v").cast("bigint").alias("dim"), F.round(norm, 6).alias("norm"))


@register("udf_3_image_requests", """
WITH img AS (SELECT DISTINCT sha256(encode(text)) AS sha256 FROM benchmark),
resp AS (SELECT sha256(encode(text)) AS sha256 FROM benchmark WHERE text < 'M')
SELECT sha256 FROM img WHERE sha256 NOT IN (SELECT sha256 FROM resp)""")
def udf_3_image_requests(spark, sf_dir):
    """Image-text requests still pending: images without a model response
    (responses exist for the passages sorting before 'M')."""
    b = read(spark, sf_dir, "benchmark")
    img = b.select(content_sha256(F.encode("text", "UTF-8")).alias("sha256")).distinct()
    resp = b.filter(F.col("text") < "M").select(content_sha256(F.encode("text", "UTF-8")).alias("sha256"))
    return EN.pending_images(img, resp)


@register("meta_5_image_profile", """
SELECT p_partkey AS id, 'image/gif' AS mime, CAST(p_size AS BIGINT) AS width, CAST(p_partkey % 300 AS BIGINT) AS height FROM part
UNION ALL SELECT p_partkey + 1000000, 'image/bmp', CAST(p_partkey % 300 AS BIGINT), CAST(p_size AS BIGINT) FROM part
UNION ALL SELECT p_partkey + 2000000, 'image/jpeg', CAST(p_size AS BIGINT), CAST(p_partkey % 300 AS BIGINT) FROM part
UNION ALL SELECT p_partkey + 3000000, 'image/tiff', CAST(p_size AS BIGINT), CAST(p_partkey % 300 AS BIGINT) FROM part
UNION ALL SELECT p_partkey + 4000000, 'image/webp', CAST(p_size + 1 AS BIGINT), CAST(p_partkey % 250 + 1 AS BIGINT) FROM part""")
def meta_5_image_profile(spark, sf_dir):
    """Image header profile (MIME, width, height) of GIF, BMP, JPEG (behind a
    comment segment), TIFF and WebP headers."""
    p = read(spark, sf_dir, "part")
    le16 = lambda c: F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256) % 256), 2, "0"))
    le32 = lambda c: F.concat(le16(c), F.lit("0000"))
    gif = F.unhex(F.concat(F.lit("474946383961"), le16(F.col("p_size")), le16(F.col("p_partkey") % 300)))
    bmp = F.unhex(F.concat(F.lit("424D"), F.lit("00" * 16), le32(F.col("p_partkey") % 300), le32(F.col("p_size"))))
    g = p.select(F.col("p_partkey").alias("id"), EN.image_profile(gif).alias("m"))
    be16 = lambda c: F.lpad(F.hex(c), 4, "0")
    jpg = F.unhex(F.concat(F.lit("FFD8FFFE0006C0C0C0C0FFC2001108"), be16(F.col("p_partkey") % 300), be16(F.col("p_size")), F.lit("03" + "00" * 9)))
    tif = F.unhex(F.concat(F.lit("4D4D002A00000008000201000003" + "00000001"), be16(F.col("p_size")), F.lit("000001010003" + "00000001"), be16(F.col("p_partkey") % 300), F.lit("000000000000")))
    web = F.unhex(F.concat(F.lit("5249464616000000574542505650385" + "80A00000000000000"), le16(F.col("p_size")), F.lit("00"), le16(F.col("p_partkey") % 250), F.lit("00")))
    b = p.select((F.col("p_partkey") + 1000000).alias("id"), EN.image_profile(bmp).alias("m"))
    for k, c in ((2, jpg), (3, tif), (4, web)):
        b = b.unionByName(p.select((F.col("p_partkey") + k * 1000000).alias("id"), EN.image_profile(c).alias("m")))
    return g.unionByName(b).select("id", "m.mime", F.col("m.width").cast("bigint").alias("width"),
                                   F.col("m.height").cast("bigint").alias("height"))


def _office_zip(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for key, name, region in zip(pdf["n_nationkey"], pdf["n_name"], pdf["r_name"]):
        core = ('<?xml version="1.0"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/'
                'metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> ' + name
                + ' </dc:title><dc:creator>' + region + '</dc:creator><dc:subject>  </dc:subject>'
                '</cp:coreProperties>')
        app = ('<?xml version="1.0"?><Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/'
               'extended-properties"><Application>Writer ' + str(key) + '</Application></Properties>')
        data = A.pack([("[Content_Types].xml", b"<Types/>"), ("word/document.xml", b"<w:document/>"),
                       ("docProps/core.xml", core.encode()), ("docProps/app.xml", app.encode())], "zip")
        rows.append((int(key), data))
    return pd.DataFrame(rows, columns=["n_nationkey", "content"])


@register("meta_6_office", """
SELECT n.n_nationkey, n.n_name AS title, r.r_name AS author, NULL::VARCHAR AS subject, 'Writer ' || n.n_nationkey AS application
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def meta_6_office(spark, sf_dir):
    """Office properties from docProps parts of OOXML files (one per nation):
    title and author from core.xml, application from app.xml; blanks dropped."""
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name", "n_regionkey")
    files = j.groupBy("n_regionkey").applyInPandas(_office_zip, "n_nationkey int, content binary")
    keys = files.select(F.sha2("content", 256).alias("sha256"), "n_nationkey")
    parts = A.explode_archives(files.select("content")).filter(F.col("path").startswith("docProps/")) \
             .select(F.col("parent_sha256").alias("sha256"), "path", F.decode("content", "UTF-8").alias("xml"))
    props = EN.office_properties(parts)
    return props.join(keys, "sha256").select(F.col("n_nationkey").cast("int"), "title", "author", "subject",
                                             "application")
