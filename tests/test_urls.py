from urllib.parse import urljoin

from pyspark.sql import functions as F

from quarry.functions.urls import absolutize, is_static_url, url_host
from tests.conftest import SF001

REFS = ["/d/1", "x/../y", "?q=1", "#f", "//cdn.example/a", "https://abs.example/z", "../up/2", "./here/3",
        "a/./b/../c", "/a/b/../../../z", "..", ".", "x/", "../../../../w"]


def test_absolutize_matches_urljoin(spark):
    pages = [r.url for r in spark.read.parquet(f"{SF001}/pages.parquet").select("url").collect()]
    pairs = [(b, r) for b in pages for r in REFS]
    df = spark.createDataFrame(pairs, "base string, ref string")
    got = [(r.base, r.ref, r.u) for r in df.select("base", "ref", absolutize(F.col("ref"), F.col("base")).alias("u")).collect()]
    bad = [(b, r, u, urljoin(b, r)) for b, r, u in got if u != urljoin(b, r)]
    assert not bad, bad[:5]


def test_host_and_static(spark):
    df = spark.createDataFrame([("https://User@Ex.Example.com:8080/a/B.PDF?x#y",), ("http://[::1]/x.txt",),
                                ("https://h.example/page.html",)], "u string")
    got = df.select(url_host(F.col("u")).alias("h"), is_static_url(F.col("u")).alias("s")).collect()
    assert [(r.h, r.s) for r in got] == [("ex.example.com", True), ("::1", True), ("h.example", False)]


def test_markdown_refs_join_a_base(spark):
    import re
    from urllib.parse import urljoin

    from quarry.functions.text import resolve_markdown_refs
    base = "https://h.example/a/b.html?x=1"
    sha = "ab" * 32
    cases = ["![i](p.png) [l](../q) text [a](http://z/) ![s](" + sha + ") [e]( x) ![](/r?s#t) [f](#g)", "none", "[x](y)![](z)", "broken [x](y", f"[n]({sha}0)"]

    def rule(m):
        bang, text, src = m.groups()
        if not src.startswith(("http://", "https://")) and not re.match(r"^[a-f0-9]{64}$", src):
            src = urljoin(base, src)
        return f"{bang}[{text}]({src})"
    df = spark.createDataFrame([(c, base) for c in cases] + [(cases[0], None)], "md string, base string")
    got = [r.m for r in df.select(resolve_markdown_refs(F.col("md"), F.col("base")).alias("m")).collect()]
    want = [re.sub(r"(!?)\[([^\]]*)\]\(([^)]+)\)", rule, c) for c in cases if "( x)" not in c]
    assert got[1:-1] == want
    assert got[0].startswith("![i](https://h.example/a/p.png) [l](https://h.example/q) text [a](http://z/) ![s](" + sha + ")")
    assert got[-1].startswith(" [l](../q) text")
