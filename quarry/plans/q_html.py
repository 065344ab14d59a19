"""Queries: HTML → markdown (documents and fragments), HTML metadata,
distinct images per file, URL absolutizing and SSRF URL safety."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.sniff import html_doc_sniff
from ..functions.text import WS, markdown_images
from .registry import register
from .sql import q
from .tables import read


# The SQL restatement converts by ordered patterns, not by tokens: right for pages
# whose removed blocks do not nest.
# (pattern, replacement) applied in order.
_BLOCKS = "p|div|ul|ol|table|section|article|main|body|html|blockquote|pre|figure|dl"
COMMON_RULES = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    (r"(?is)<noscript\b[^>]*>.*?</noscript\s*>", ""),
    (r"(?is)<head\b[^>]*>.*?</head\s*>", ""),
    (r"(?is)<!doctype[^>]*>", ""),
]
BOILERPLATE_RULES = [
    (r"(?is)<nav\b[^>]*>.*?</nav\s*>", ""),
    (r"(?is)<aside\b[^>]*>.*?</aside\s*>", ""),
    (r"(?is)<header\b[^>]*>.*?</header\s*>", ""),
    (r"(?is)<footer\b[^>]*>.*?</footer\s*>", ""),
    (r"(?is)<form\b[^>]*>.*?</form\s*>", ""),
    (r"""(?is)<div\b[^>]*\bclass\s*=\s*["'][^"']*\b(ad|ads|advert|sidebar|cookie|banner)\b[^"']*["'][^>]*>.*?</div\s*>""", ""),
]
CONVERT_RULES = [
    *[(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)],
    (r"""(?is)<img\b[^>]*\bsrc\s*=\s*["']([^"']*)["'][^>]*>""", "![]($1)"),
    (r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>""", "[$2]($1)"),
    (r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)\s*>", "**$1**"),
    (r"(?is)<(?:i|em)\b[^>]*>(.*?)</(?:i|em)\s*>", "*$1*"),
    (r"(?is)<li\b[^>]*>", "\n- "),
    (r"(?is)<tr\b[^>]*>", "\n| "),
    (r"(?is)</t[dh]\s*>", " | "),
    (r"(?is)</?(?:tr|td|th|thead|tbody|tfoot)\b[^>]*>", ""),
    (r"(?is)<br\s*/?>", "\n"),
    (rf"(?is)</?(?:{_BLOCKS})\b[^>]*>", "\n\n"),
    (r"(?s)<[^>]*>", ""),
]
SPACE_RULES = [
    (r"[ \t\x{a0}]+", " "),
    (r"(?m)^ +| +$", ""),
    (r"\n{3,}", "\n\n"),
    (f"^[{WS}]+|[{WS}]+$", ""),
]




def _rules(document: bool):
    return COMMON_RULES + (BOILERPLATE_RULES if document else []) + CONVERT_RULES


def _sql_apply(x: str, rs) -> str:
    for pat, rep in rs:
        rep = re.sub(r"\$(\d)", r"\\\1", rep)
        x = f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"
    return x


def _sql_entities(x: str) -> str:
    for ent, ch in H.ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def _sql_markdown(x: str, document: bool) -> str:
    return _sql_apply(_sql_entities(_sql_apply(x, _rules(document))), SPACE_RULES)


SNIFF_SQL = "regexp_matches(left(regexp_replace(left({x}, 10000), '[" + WS + "]+', ' ', 'g'), 100), '(?i)<(!doctype|html)\\b')"


@register("str_9_html_markdown", f"""
SELECT page_id, sha256(md) AS sha256, CAST(length(md) AS BIGINT) AS n_chars,
  CAST(len(regexp_extract_all(md, '\\[([^\\]]*)\\]\\(([^)]+)\\)', 2)) AS BIGINT) AS n_links
FROM (SELECT page_id, CASE WHEN {SNIFF_SQL.replace('{x}', 'html')} THEN {_sql_markdown('html', True)}
                           ELSE {_sql_markdown('html', False)} END AS md FROM pages)""")
def str_9_html_markdown(spark, sf_dir):
    """Web pages → markdown: boilerplate (nav, ads, footer, scripts) removed,
    headings, emphasis, links and images kept."""
    p = read(spark, sf_dir, "pages")
    md = H.html_to_markdown(F.col("html"), html_doc_sniff(F.col("html")))
    return p.select("page_id", F.sha2(md, 256).alias("sha256"), F.length(md).cast("bigint").alias("n_chars"),
                    F.size(F.regexp_extract_all(md, F.lit(r"\[([^\]]*)\]\(([^)]+)\)"), 2)).cast("bigint").alias("n_links"))


FRAG_SQL = ("'<div><h2>' || lang || ' &amp; ' || source || '</h2><p>' || replace(text, chr(10), '<br>') || "
            "'</p><ul><li><a href=\"/d/' || doc_id || '\">doc <b>' || doc_id || '</b></a></li><li><i>x</i> &lt;y&gt;</li></ul>"
            "<img src=\"https://img.example/' || lang || '.png\"><img alt=\"a\" src=\"https://img.example/' || lang || '.png\">"
            "<img src=\"https://img.example/d' || doc_id || '.jpg\"></div>'")


def _fragment():
    did = F.col("doc_id").cast("string")
    return F.concat(F.lit("<div><h2>"), "lang", F.lit(" &amp; "), "source", F.lit("</h2><p>"),
                    F.replace("text", F.lit("\n"), F.lit("<br>")),
                    F.lit('</p><ul><li><a href="/d/'), did, F.lit('">doc <b>'), did,
                    F.lit('</b></a></li><li><i>x</i> &lt;y&gt;</li></ul><img src="https://img.example/'), "lang",
                    F.lit('.png"><img alt="a" src="https://img.example/'), "lang",
                    F.lit('.png"><img src="https://img.example/d'), did, F.lit('.jpg"></div>'))


@register("str_10_fragment", f"""
SELECT doc_id, sha256(md) AS sha256, CAST(length(md) AS BIGINT) AS n_chars
FROM (SELECT doc_id, {_sql_markdown(FRAG_SQL, False)} AS md FROM documents)""")
def str_10_fragment(spark, sf_dir):
    """HTML fragments (documents wrapped in markup) → markdown without
    main-content extraction."""
    d = read(spark, sf_dir, "documents")
    md = H.html_to_markdown(_fragment(), F.lit(False))
    return d.select("doc_id", F.sha2(md, 256).alias("sha256"), F.length(md).cast("bigint").alias("n_chars"))


@register("agg_4_images", f"""
SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform(
         list_filter(regexp_extract_all(md, '(!?\\[[^\\]]*\\]\\([^)]+\\))', 1), lambda r: starts_with(r, '![')),
         lambda r: regexp_extract(r, '\\]\\(([^)]+)\\)$', 1)), lambda t: regexp_matches(t, '^https?://')))) AS BIGINT) AS n_images
FROM (SELECT doc_id, {_sql_markdown(FRAG_SQL, False)} AS md FROM documents)""")
def agg_4_images(spark, sf_dir):
    """Distinct external images per converted file (duplicates counted once)."""
    d = read(spark, sf_dir, "documents")
    md = H.html_to_markdown(_fragment(), F.lit(False))
    return d.select("doc_id", F.size(markdown_images(md)).cast("bigint").alias("n_images"))


def _sql_clean(x):
    return f"nullif(regexp_replace({_sql_entities(x)}, '^[{WS}]+|[{WS}]+$', '', 'g'), '')"


@register("str_11_meta", f"""
SELECT page_id,
  {_sql_clean("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")} AS title,
  {_sql_clean("regexp_extract(html, '(?is)<html\\b[^>]*\\blang\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)")} AS lang
FROM pages""")
def str_11_meta(spark, sf_dir):
    """HTML metadata: title and language (entities decoded, blanks omitted)."""
    p = read(spark, sf_dir, "pages")
    m = H.html_metadata(F.col("html"))
    return p.select("page_id", m["title"].alias("title"), m["lang"].alias("lang"))


# ------------------------------------------------------------ URLs

REFS = ["/d/{id}", "x/../y{id}", "?q={id}", "#f{id}", "//cdn.example/{id}", "https://abs.example/{id}",
        "../up/{id}", "./here/{id}", "", "a/./b/../c{id}", "/a/b/../../../z{id}"]


def _refs_spark():
    did = F.col("page_id").cast("string")
    out = []
    for i, r in enumerate(REFS):
        a, _, b = r.partition("{id}")
        out.append((i, F.concat(F.lit(a), did, F.lit(b)) if "{id}" in r else F.lit(r)))
    return out


def _sql_remove_dots(p: str) -> str:
    fold = f"""list_reduce(string_split({p}, '/'), lambda acc, s:
       CASE WHEN s = '.' THEN acc WHEN s = '..' THEN CASE WHEN len(acc) > 1 THEN acc[1:len(acc) - 1] ELSE acc END
            ELSE list_append(acc, s) END, []::VARCHAR[])"""
    j = f"array_to_string({fold}, '/')"
    last = f"string_split({p}, '/')[-1]"
    return f"CASE WHEN {last} IN ('.', '..') AND NOT ends_with({j}, '/') THEN {j} || '/' ELSE {j} END"


URL_RE_SQL = q(U.URL_RE)


@register("str_7_absolutize", "WITH r AS (" + " UNION ALL ".join(
    f"SELECT page_id, {i} AS pos, url AS base, " + (f"'{a}' || page_id || '{b}'" if "{id}" in ref else f"'{ref}'") + " AS ref FROM pages"
    for i, ref in enumerate(REFS) for a, _, b in [ref.partition("{id}")]) + f"""),
p AS (SELECT page_id, pos, ref,
   regexp_extract(base, {URL_RE_SQL}, 1) AS scheme, regexp_extract(base, {URL_RE_SQL}, 3) AS auth,
   regexp_extract(base, {URL_RE_SQL}, 4) AS bpath, regexp_extract(base, {URL_RE_SQL}, 5) AS bquery,
   regexp_extract(ref, '^([^?#]*)', 1) AS rpath FROM r),
p2 AS (SELECT *, substring(ref, length(rpath) + 1) AS rtail, regexp_extract(bpath, '^(.*/)', 1) AS dir FROM p)
SELECT page_id, pos,
  CASE WHEN regexp_matches(ref, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN ref
       WHEN starts_with(ref, '//') THEN scheme || ':' || ref
       WHEN starts_with(ref, '/') THEN scheme || '://' || auth || {_sql_remove_dots('rpath')} || rtail
       WHEN starts_with(ref, '?') THEN scheme || '://' || auth || bpath || ref
       WHEN starts_with(ref, '#') THEN scheme || '://' || auth || bpath || bquery || ref
       WHEN ref = '' THEN scheme || '://' || auth || bpath || bquery
       ELSE scheme || '://' || auth || {_sql_remove_dots("CASE WHEN auth <> '' AND bpath = '' THEN '/' || rpath ELSE dir || rpath END")} || rtail
  END AS url
FROM p2""")
def str_7_absolutize(spark, sf_dir):
    """Absolutize link targets of every page against its URL (absolute,
    network-path, root, query, fragment, empty and relative references)."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    parts = [p.select("page_id", F.lit(i).alias("pos"), U.absolutize(r, F.col("url")).alias("url"))
             for i, r in _refs_spark()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _url_variants():
    pid = F.col("page_id")
    s = lambda c: c.cast("string")
    return [
        F.col("url"),
        F.concat(F.lit("http://127.0.0."), s(pid % 250 + 1), F.lit("/x")),
        F.concat(F.lit("https://192.168.1."), s(pid % 250), F.lit("/")),
        F.concat(F.lit("http://93.184.216."), s(pid % 250), F.lit("/p")),
        F.concat(F.lit("ftp://files.example.com/"), s(pid)),
        F.lit("http://[::1]/admin"),
        F.concat(F.lit("http://169.254.169."), s(pid % 250), F.lit("/meta")),
        F.lit("http:///nohost"),
        F.concat(F.lit("http://[fe80::"), s(pid % 9), F.lit("]/")),
        F.concat(F.lit("https://[2606:4700::"), s(pid % 9), F.lit("]/")),
    ]


URL_VARIANTS_SQL = ["url", "'http://127.0.0.' || (page_id % 250 + 1) || '/x'", "'https://192.168.1.' || (page_id % 250) || '/'",
                    "'http://93.184.216.' || (page_id % 250) || '/p'", "'ftp://files.example.com/' || page_id",
                    "'http://[::1]/admin'", "'http://169.254.169.' || (page_id % 250) || '/meta'", "'http:///nohost'",
                    "'http://[fe80::' || (page_id % 9) || ']/'", "'https://[2606:4700::' || (page_id % 9) || ']/'"]


def _host_ips(spark, sf_dir):
    """Resolver answers per page host: private, public, mixed or none."""
    p = read(spark, sf_dir, "pages").select("page_id", U.url_host(F.col("url")).alias("host"))
    k = F.col("page_id") % 4
    a = p.filter(k == 0).select("host", F.concat(F.lit("10.0.0."), (F.col("page_id") % 250).cast("string")).alias("ip"))
    b = p.filter(k.isin(1, 2)).select("host", F.lit("93.184.216.34").alias("ip"))
    c = p.filter(k == 2).select("host", F.lit("172.16.5.4").alias("ip"))
    return a.unionByName(b).unionByName(c)


def _sql_v4_long(x):
    return (f"CASE WHEN regexp_matches({x}, '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}$') "
            f"THEN CAST(split_part({x}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({x}, '.', 2) AS BIGINT) * 65536 "
            f"+ CAST(split_part({x}, '.', 3) AS BIGINT) * 256 + CAST(split_part({x}, '.', 4) AS BIGINT) END")


def _sql_v4_blocked(n):
    return "(" + " OR ".join(f"{n} BETWEEN {lo} AND {hi}" for lo, hi in U.BLOCKED_V4) + ")"


def _sql_ip_blocked(h):
    v4 = _sql_v4_long(h)
    mapped = f"regexp_extract(lower({h}), '^::ffff:([0-9.]+)$', 1)"
    v6 = (f"(lower({h}) IN ('::1', '::') OR regexp_matches(lower({h}), '^fe[89ab][0-9a-f]:') "
          f"OR regexp_matches(lower({h}), '^f[cd][0-9a-f]{{2}}:') OR regexp_matches(lower({h}), '^2001:0?db8:') "
          f"OR ({mapped} <> '' AND coalesce({_sql_v4_blocked(_sql_v4_long(mapped))}, false)))")
    return f"CASE WHEN {v4} IS NOT NULL THEN {_sql_v4_blocked(v4)} ELSE {v6} END"


HOST_SQL = ("nullif(lower(CASE WHEN starts_with(regexp_replace({n}, '^.*@', ''), '[') "
            "THEN regexp_extract(regexp_replace({n}, '^.*@', ''), '^\\[([^\\]]*)\\]', 1) "
            "ELSE regexp_replace(regexp_replace({n}, '^.*@', ''), ':[0-9]*$', '') END), '')")


@register("flt_4_url_safety", "WITH v AS (" + " UNION ALL ".join(
    f"SELECT page_id * 10 + {i} AS id, {e} AS url FROM pages" for i, e in enumerate(URL_VARIANTS_SQL)) + f"""),
hp AS (SELECT page_id, {HOST_SQL.format(n=f"regexp_extract(url, {URL_RE_SQL}, 3)")} AS host FROM pages),
hi AS (SELECT host, '10.0.0.' || (page_id % 250) AS ip FROM hp WHERE page_id % 4 = 0
       UNION ALL SELECT host, '93.184.216.34' FROM hp WHERE page_id % 4 IN (1, 2)
       UNION ALL SELECT host, '172.16.5.4' FROM hp WHERE page_id % 4 = 2),
ph AS (SELECT lower(host) AS rhost, count(*) AS n_ips, bool_or({_sql_ip_blocked('lower(ip)')}) AS any_blocked FROM hi GROUP BY 1),
u AS (SELECT id, url, {HOST_SQL.format(n=f"regexp_extract(url, {URL_RE_SQL}, 3)")} AS host,
             lower(nullif(regexp_extract(url, {URL_RE_SQL}, 1), '')) AS scheme FROM v)
SELECT id, url, coalesce(host IS NOT NULL AND scheme IN ('http', 'https') AND
   CASE WHEN {_sql_v4_long('host')} IS NOT NULL OR (contains(host, ':') AND regexp_matches(host, '^[0-9a-f:.]+$'))
        THEN NOT {_sql_ip_blocked('host')}
        ELSE coalesce(n_ips > 0, false) AND NOT coalesce(any_blocked, false) END, false) AS safe
FROM u LEFT JOIN ph ON u.host = ph.rhost""")
def flt_4_url_safety(spark, sf_dir):
    """SSRF check: http(s) only, a host required, literal IPs must be public,
    hostnames must resolve (host_ips table) to public addresses only."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    parts = [p.select((F.col("page_id") * 10 + i).alias("id"), e.alias("url")) for i, e in enumerate(_url_variants())]
    urls = parts[0]
    for x in parts[1:]:
        urls = urls.unionByName(x)
    out = U.url_safety(urls, _host_ips(spark, sf_dir))
    return out.select("id", "url", F.coalesce("safe", F.lit(False)).alias("safe"))
