import gzip
import io

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarry.functions import sniff as S
from quarry.sources.archives import pack


def _parquet_bytes():
    buf = io.BytesIO()
    pq.write_table(pa.table({"a": [1, 2]}), buf)
    return buf.getvalue()


def test_kinds_and_routes(spark):
    odp = pack([("mimetype", b"application/vnd.oasis.opendocument.presentation"), ("content.xml", b"<x/>")], "zip")
    cases = {
        "zip": (pack([("a.txt", b"hi")], "zip"), "archive"),
        "docx": (pack([("[Content_Types].xml", b"<T/>"), ("word/document.xml", b"<w/>")], "zip"), "office"),
        "odp": (odp, "office"),
        "gz": (gzip.compress(b"hello", mtime=0), "archive"),
        "tar": (pack([("a.txt", b"x" * 10)], "tar"), "archive"),
        "parquet": (_parquet_bytes(), "parquet"),
        "jpg": (b"\xff\xd8\xff\xe0" + b"\x00" * 20, "image"),
        "webp": (b"RIFF\x10\x00\x00\x00WEBPVP8 " + b"\x00" * 8, "image"),
        "ole": (bytes.fromhex("D0CF11E0A1B11AE1") + b"\x00" * 20, "office"),
        "pdf": (b"%PDF-1.4\n%...", "pdf"),
        None: (b'{"a": 1}', "json"),
    }
    texts = {"ndjson": (b'{"a": 1}\n{"a": 2}\n', "ndjson"), "csv": (b"a;b\n1;2\n3;4\n5;6\n7;8\n", "csv"),
             "html": (b"<!DOCTYPE html><html><body>x</body></html>", "html"), "md": (b"# Title\n\ntext", "markdown"),
             "latin": (b"caf\xe9 au lait", "markdown")}
    rows = [(str(k), bytearray(v[0]), v[1]) for k, v in list(cases.items()) + list(texts.items())]
    df = spark.createDataFrame(rows, "name string, content binary, want string")
    got = {r.name: (r.kind, r.route) for r in S.with_route(df, "content", "route", kind_out="kind").collect()}
    for name, kind_route in got.items():
        want_route = [r for r in rows if r[0] == name][0][2]
        assert kind_route[1] == want_route, (name, kind_route)
        if name in ("zip", "docx", "odp", "gz", "tar", "parquet", "jpg", "webp", "ole", "pdf"):
            assert kind_route[0] == name, (name, kind_route)
    ct = df.select("name", S.content_type(S.route(F.col("content")), S.sniff_kind(F.col("content"))).alias("ct"))
    cts = {r.name: r.ct for r in ct.collect()}
    assert cts["docx"].endswith("wordprocessingml.document") and cts["jpg"] == "image/jpeg"
    assert cts["csv"] == "text/csv" and cts["html"] == "text/html" and cts["zip"] is None


def test_containers_have_no_text(spark):
    """A kind that routes by itself is neither decoded nor searched for a dialect."""
    df = spark.createDataFrame([("bmp", bytearray(b"BM,x\n" + b"1,2\n" * 20)), ("csv", bytearray(b"a,x\n" + b"1,2\n" * 20))], "name string, content binary")
    got = {r.name: (r.route, r.dialect is None) for r in S.with_route(df, dialect_out="dialect").collect()}
    assert got == {"bmp": ("image", True), "csv": ("csv", False)}


def test_quote_and_page_searches(spark):
    """The plain searches that come first find what the patterns find."""
    texts = ['"a",b', 'a"b', "x,'y'", "it's", '"a\\"b"', " \n" * 200 + "<!DocType html>", "<htmlx>", "x" * 99 + "<html>", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    row = df.select("i", *[S._used(t, q, e).alias(f"u{n}") for n, (q, e) in enumerate(S.QUOTINGS[1:])], S.html_doc_sniff(t).alias("page")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in row[:5]] == [(True, False, False, False, False), (False,) * 5, (False, False, True, False, False), (False,) * 5,
                                               (True, True, False, False, False)]
    assert [r.page for r in row[5:]] == [True, False, False, None]
