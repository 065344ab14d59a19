"""URL predicates and rewriting as Column expressions: static-file test,
size guard, URL parts, absolutizing references against a base URL, and the
SSRF address classification (literal IPs and resolved host addresses)."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind

# Extensions fetched directly instead of through a browser.
STATIC_EXTS = ["pdf", "jpg", "jpeg", "png", "gif", "webp", "svg", "doc", "docx", "ppt", "pptx", "xls", "xlsx",
               "ods", "odp", "odt", "csv", "txt", "md", "zip", "tar", "gz"]
STATIC_RE = r"\.(" + "|".join(STATIC_EXTS) + r")$"
URL_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def url_scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, URL_RE, 1), F.lit("")))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, URL_RE, 3)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, URL_RE, 4)


def url_host(url: Column) -> Column:
    """Lower-cased host without user info, port or IPv6 brackets (null if none)."""
    net = F.regexp_replace(url_netloc(url), r"^.*@", "")
    h = F.when(net.startswith("["), F.regexp_extract(net, r"^\[([^\]]*)\]", 1)) \
         .otherwise(F.regexp_replace(net, r":[0-9]*$", ""))
    return F.nullif(F.lower(h), F.lit(""))


def is_static_url(url: Column, content_type: Column | None = None) -> Column:
    """Lower-cased URL path ends with a static-file extension; not so if the
    response is served as ``text/html``."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    named = F.lower(path).rlike(STATIC_RE)
    return named if content_type is None else named & ~F.coalesce(F.lower(content_type).startswith("text/html"), F.lit(False))


def within_size(n: Column, limit: int) -> Column:
    """False for a declared size of digits above the limit; an absent or
    non-digit declaration passes (the body itself is measured later)."""
    s = n.cast("string")
    over = s.rlike(r"^[0-9]+$") & (F.length(F.regexp_replace(s, "^0+", "")).cast("int") > 18) | (s.try_cast("decimal(38,0)") > F.lit(limit))
    return ~F.coalesce(s.rlike(r"^[0-9]+$") & over, F.lit(False))


# ------------------------------------------------------------ absolutize

def _remove_dots(path: Column) -> Column:
    """RFC 3986 dot-segment removal on a path (fold over its segments)."""
    segs = F.split(path, "/", -1)
    zero = F.array().cast("array<string>")

    def step(acc, s):
        return (F.when(s == ".", acc)
                 .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
                 .otherwise(F.array_append(acc, s)))
    out = F.aggregate(segs, zero, step)
    last = F.element_at(segs, -1)
    trailing = last.isin(".", "..")
    joined = F.array_join(out, "/")
    return F.when(trailing & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def absolutize(ref: Column, base: Column) -> Column:
    """Resolve ``ref`` against an absolute ``base`` URL (RFC 3986 subset:
    absolute, network-path, absolute-path, query-only, fragment-only, empty
    and relative-path references with dot segments)."""
    scheme = F.regexp_extract(base, URL_RE, 1)
    auth = F.regexp_extract(base, URL_RE, 3)
    bpath = F.regexp_extract(base, URL_RE, 4)
    bquery = F.regexp_extract(base, URL_RE, 5)
    origin = F.concat(scheme, F.lit("://"), auth)
    rpath = F.regexp_extract(ref, r"^([^?#]*)", 1)
    rtail = F.substring(ref, F.length(rpath) + 1, 1 << 30)
    dir_ = F.regexp_extract(bpath, r"^(.*/)", 1)
    merged = F.when((auth != "") & (bpath == ""), F.concat(F.lit("/"), rpath)).otherwise(F.concat(dir_, rpath))
    return (F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
             .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
             .when(ref.startswith("/"), F.concat(origin, _remove_dots(rpath), rtail))
             .when(ref.startswith("?"), F.concat(origin, bpath, ref))
             .when(ref.startswith("#"), F.concat(origin, bpath, bquery, ref))
             .when(ref == "", F.concat(origin, bpath, bquery))
             .otherwise(F.concat(origin, _remove_dots(merged), rtail)))


# ------------------------------------------------------------- SSRF rules

def _blocked_v4() -> list[tuple[int, int]]:
    """IPv4 ranges that are private, loopback or link-local per the standard
    library's address tables (ranges minus the listed exceptions)."""
    probe = []
    for net in ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
                "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15",
                "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32"]:
        n = ipaddress.ip_network(net)
        probe.append((int(n.network_address), int(n.broadcast_address)))
    # keep only addresses the standard library classifies as blocked, split into runs
    out = []
    for lo, hi in probe:
        for sub in _runs(lo, hi):
            out.append(sub)
    return out


def _is_blocked(ip) -> bool:
    return ip.is_private or ip.is_loopback or ip.is_link_local


def _runs(lo: int, hi: int) -> list[tuple[int, int]]:
    """Maximal runs of blocked addresses in [lo, hi], found by bisection on
    CIDR blocks that are uniformly classified."""
    res = []

    def walk(net):
        first, last = net.network_address, net.broadcast_address
        a, b = _is_blocked(first), _is_blocked(last)
        if net.prefixlen >= 32 or (a == b and all(_is_blocked(x) == a for x in _samples(net))):
            if a:
                res.append((int(first), int(last)))
            return
        for s in net.subnets(1):
            walk(s)
    walk(ipaddress.ip_network(f"{ipaddress.ip_address(lo)}/{32 - (hi - lo + 1).bit_length() + 1}", strict=False))
    merged = []
    for a, b in sorted(res):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _samples(net):
    n = net.num_addresses
    if n <= 16:
        return list(net)
    step = n // 16
    return [net.network_address + i * step for i in range(16)] + [net.broadcast_address]


BLOCKED_V4 = _blocked_v4()


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad → number; null when not a strict dotted quad."""
    ok = ip.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
    p = F.split(ip, r"\.")
    n = (p[0].cast("bigint") * 16777216 + p[1].cast("bigint") * 65536 + p[2].cast("bigint") * 256
         + p[3].cast("bigint"))
    return F.when(ok, n)


def ipv4_blocked(n: Column) -> Column:
    cond = F.lit(False)
    for lo, hi in BLOCKED_V4:
        cond = cond | n.between(lo, hi)
    return cond


def ipv6_hex(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address in any textual form (compressed,
    leading zeros left out, dotted tail); null when it is none."""
    def groups(side):
        return F.transform(F.filter(F.split(F.coalesce(side, F.lit("")), ":", -1), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))

    def undotted(h):
        return bind(ipv4_to_long(F.regexp_extract(h, r":([0-9.]+\.[0-9.]+)$", 1)), lambda n: F.when(n.isNull(), h).otherwise(
            bind(F.lpad(F.lower(F.hex(n)), 8, "0"), lambda x: F.concat(F.regexp_replace(h, r"[0-9.]+$", ""), F.substring(x, 1, 4), F.lit(":"), F.substring(x, 5, 4)))))

    def expanded(h):
        form = h.rlike(r"^[0-9a-f:]+$") & ~h.rlike(r"[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$")
        return F.when(form, bind(F.split(h, "::", -1), lambda s: bind(F.struct(
            groups(F.get(s, F.lit(0))).alias("l"), groups(F.get(s, F.lit(1))).alias("r"), F.size(s).alias("n")), joined)))

    def joined(g):
        gap = F.lit(8) - F.size(g["l"]) - F.size(g["r"])
        whole = F.concat(F.array_join(g["l"], ""), F.repeat(F.lit("0000"), gap), F.array_join(g["r"], ""))
        return F.when(F.when(g["n"] == 2, gap >= 1).otherwise(gap == 0), whole)

    return bind(bind(F.lower(F.regexp_replace(ip, "%.*$", "")), undotted), expanded)


# IPv6 ranges that are private, loopback, link-local or otherwise
# not public, as the first hex digits that they share.
BLOCKED_V6_PREFIX = r"^(0{31}[01]|fe[89ab]|f[cd]|20010db8|0100000000000000|20010000|20010002000[0]|2001001|3fff0)"


def ipv6_blocked(ip: Column) -> Column:
    """Judged on the expanded address; IPv4-mapped ones by their IPv4 part.  Text
    that is no address is blocked."""
    def judge(full):
        mapped = F.conv(F.substring(full, 25, 8), 16, 10).cast("bigint")
        return F.when(full.startswith("0" * 20 + "ffff"), bind(mapped, ipv4_blocked)).otherwise(full.rlike(BLOCKED_V6_PREFIX))
    return F.coalesce(bind(ipv6_hex(ip), judge), F.lit(True))


def is_literal_ip(h: Column) -> Column:
    return ipv4_to_long(h).isNotNull() | (h.contains(":") & h.rlike(r"^[0-9a-f:.]+$"))


def ip_blocked(h: Column) -> Column:
    return bind(ipv4_to_long(h), lambda v4: F.when(v4.isNotNull(), ipv4_blocked(v4)).otherwise(ipv6_blocked(h)))


def url_safety(urls: DataFrame, host_ips: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``safe``: http(s) scheme, a host, and either a public literal IP
    or a host whose resolved addresses (``host_ips(host, ip)``) are all
    public and at least one.  Resolution rows are pre-aggregated per host
    before the join, so a host with many addresses stays one row."""
    per_host = (host_ips.groupBy(F.lower("host").alias("rhost"))
                        .agg(F.count(F.lit(1)).alias("n_ips"),
                             F.bool_or(ip_blocked(F.lower(F.col("ip")))).alias("any_blocked")))
    u = urls.withColumn("_host", url_host(F.col(url_col))).withColumn("_scheme", url_scheme(F.col(url_col)))
    j = u.join(per_host, u["_host"] == per_host["rhost"], "left")
    safe = (F.col("_host").isNotNull() & F.col("_scheme").isin("http", "https")
            & F.when(is_literal_ip(F.col("_host")), ~ip_blocked(F.col("_host")))
               .otherwise(F.coalesce(F.col("n_ips") > 0, F.lit(False)) & ~F.coalesce(F.col("any_blocked"), F.lit(False))))
    return j.withColumn("safe", safe).drop("_host", "_scheme", "rhost", "n_ips", "any_blocked")
