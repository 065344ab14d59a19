import posixpath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.sniff import html_doc_sniff
from quarry.sources.archives import member_path, sanitize_path


def test_markdown_refs_by_hand(spark):
    sha = "a" * 64
    cases = {"[t](u![a](b)": "[t](u![a](b)", "![x](rel.png)![y](https://a/b.png)": "![y](https://a/b.png)",
             f"![h]({sha}) [r](r)": f"![h]({sha}) [r](r)", "a ![gone](x.gif) b": "a  b", "[keep](../up)": "[keep](../up)"}
    images = {"![x](rel.png)![y](https://a/b.png)": ["https://a/b.png"]}
    df = spark.createDataFrame([(c,) for c in cases], "md string")
    for r in df.select("md", T.resolve_markdown_refs(F.col("md")).alias("r"), T.markdown_images(F.col("md")).alias("i")).collect():
        assert r.r == cases[r.md] and list(r.i) == images.get(r.md, [])


def test_html_sniff_by_hand(spark):
    cases = {"\n\n   <HTML>x": True, "<p>x</p>": False, "<!DocType html>": True, " " * 200 + "<html>": True, "x" * 101 + "<html>": False,
             "<htmlx>": False, "text <html>": True}
    df = spark.createDataFrame([(c,) for c in cases], "html string")
    assert {r.html: r.s for r in df.select("html", html_doc_sniff(F.col("html")).alias("s")).collect()} == cases


def _py_sanitize(name):
    clean = posixpath.normpath(name).lstrip("/")
    return None if clean.startswith("..") else clean


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", "", "c.d", "..x"]), min_size=1, max_size=6)
                .map(lambda parts: "/".join(parts)), min_size=1, max_size=30),
       st.booleans())
def test_sanitize_matches_normpath(spark, paths, absolute):
    paths = [("/" + p) if absolute else p for p in paths]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.c for r in df.select(sanitize_path(F.col("p")).alias("c")).collect()]
    assert got == [_py_sanitize(p) for p in paths] == [member_path(p) for p in paths]


def test_data_uri_payloads_are_decoded_once(spark):
    """A long page costs a few passes over it, whatever its payloads need."""
    import base64
    import hashlib
    import time
    raw = bytes(range(256)) * 6000
    b64 = base64.b64encode(raw).decode()
    page = f'<img src="data:image/png;base64,{b64}"><img src="data:image/gif;base64,{b64[:-2]}*\n{b64[-2:]}">'
    df = spark.createDataFrame([(page,)] * 4, "h string").coalesce(1)
    t0 = time.time()
    got = {r.o for r in df.select(T.replace_data_uris(F.col("h")).alias("o")).collect()}
    took = time.time() - t0
    sha = hashlib.sha256(raw).hexdigest()
    assert got == {f'<img src="{sha}"><img src="{sha}">'}
    plan = df.select(T.replace_data_uris(F.col("h")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unbase64(") + plan.count("UnBase64(") + plan.count("to_binary(") <= 1, plan.count("base64")
    assert took < 60


def test_data_uri_replacement_matches_rule(spark):
    import base64
    import hashlib
    import re
    pat = re.compile(r'''(src\s*=\s*)(["'])data:image/([^;]+);base64,([^"']+)\2''', re.IGNORECASE)

    def rule(html):
        def rep(m):
            try:
                b = base64.b64decode(m.group(4))
            except Exception:  # noqa: BLE001
                return m.group(0)
            return f"{m.group(1)}{m.group(2)}{hashlib.sha256(b).hexdigest()}{m.group(2)}"
        return pat.sub(rep, html)
    payloads = ["aGVsbG8=", "@@", "YQ", "YQ==", "Y Q = =", "aGVs bG8=", "!!aGVsbG8=", "aGVsbG8", "===="]
    htmls = [f'<p>x</p><img src="data:image/png;base64,{p}"><IMG SRC = \'data:image/gif;base64,{p}\'>' for p in payloads]
    df = spark.createDataFrame([(h,) for h in htmls], "h string")
    got = [r.o for r in df.select(T.replace_data_uris(F.col("h")).alias("o")).collect()]
    assert got == [rule(h) for h in htmls]


def _normalize_rule(b: bytes) -> str:
    try:
        t = b.decode("utf-8")
    except UnicodeDecodeError:
        t = b.decode("latin-1")
    return t.replace("\r\n", "\n").replace("\r", "\n")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=12),
                          st.sampled_from([b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\xe9\r\n", b"ok\r\r\n",
                                           "é😀".encode(), b"\xef\xbb\xbfbom"])),
                min_size=1, max_size=25))
def test_normalize_matches_rule(spark, blobs):
    df = spark.createDataFrame([(bytearray(b),) for b in blobs], "b binary")
    got = [r.t for r in df.select(T.normalize_text(F.col("b")).alias("t")).collect()]
    assert got == [_normalize_rule(b) for b in blobs]
