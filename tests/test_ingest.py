"""The composed ingest on small files of every text route."""

import base64

from pyspark.sql import functions as F

from quarry.operators.ingest import ingest
from quarry.sources import archives as A
from quarry.sources.formats import read_cascade
from quarry.functions import sniff as S

PNG = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNkYPhfDwAChwGA60e6kgAAAABJRU5ErkJggg==")
CSV = 'name,city,n\n"Doe, J",Rome,1\n"Roe ""R""",Oslo,2\nA,B,3\nC,D,4\nE,F\nG,H,6,extra\n' + "".join(f"x{i},y,{i}\n" for i in range(20))


def _requests(spark, rows):
    return spark.createDataFrame([(s, i, bytearray(b) if b is not None else None) for s, i, b in rows], "source string, source_id string, content binary")


def test_routes_tables_images_and_generations(spark):
    page = f'<!DOCTYPE html><html lang="en"><head><title>T</title></head><body><p>see</p><img src="data:image/png;base64,{base64.b64encode(PNG).decode()}"></body></html>'
    inner = A.pack([("deep.md", b"# deep text")], "tar")
    box = A.pack([("a.csv", CSV.encode()), ("../evil", b"e"), ("in.tar", inner), ("same.txt", b"plain text")], "zip")
    rows = [("s", "1", page.encode()), ("s", "2", CSV.encode()), ("s", "3", box), ("t", "4", b"plain text"), ("t", "5", b'[{"a": 1, "b": {"c": "x|y"}}]'),
            ("t", "6", b'{"k": 1}\n{"k": 2}\n'), ("t", "7", None), ("t", "8", b"PK\x03\x04broken")]
    got = ingest(_requests(spark, rows))
    files = {r.sha256: r for r in got.files.collect()}
    kinds = sorted((r.route, r.generation) for r in files.values())
    assert kinds == [("archive", 0), ("archive", 0), ("csv", 0), ("html", 0), ("image", 1), ("json", 0), ("markdown", 0), ("markdown", 1), ("ndjson", 0)]
    csv = next(r for r in files.values() if r.route == "csv")
    lines = csv.markdown.split("\n")
    assert lines[0] == "RowID | name | city | n" and lines[2] == "1 | Doe, J | Rome | 1" and lines[3] == '2 | Roe "R" | Oslo | 2'
    assert lines[6] == "5 | E | F | " and lines[7] == "6 | G | H | 6" and csv.meta["num_rows"] == "26"
    doc = next(r for r in files.values() if r.route == "json")
    assert doc.markdown == "RowID | a | b.c\n- | - | -\n1 | 1 | x¦y"
    html = next(r for r in files.values() if r.route == "html")
    image = next(r for r in files.values() if r.route == "image")
    assert html.meta["title"] == "T" and image.sha256 in html.markdown and image.meta["content_type"] == "image/png"
    edges = {(e.meta["index"], e.meta.get("filename")) for e in got.edges.collect()}
    assert edges == {("parent", "a.csv"), ("parent", "in.tar/deep.md"), ("parent", "same.txt"), ("child", None)}
    assert got.blobs.filter(F.col("content_type").isNull()).count() == 0 and got.blobs.count() == 7
    assert got.sources.count() == 8 and got.chunks.count() >= 6


def test_known_files_and_bounds(spark):
    rows = [("s", "1", b"one"), ("s", "2", b"two"), ("s", "3", A.pack([("x", b"three")], "zip"))]
    req = _requests(spark, rows)
    first = ingest(req)
    again = ingest(req, first.files.select("sha256"))
    assert again.files.count() == 0 and again.sources.count() == 3
    try:
        ingest(req, max_generations=1)
        raise AssertionError("the bound must raise")
    except RuntimeError as e:
        assert "generations" in str(e)


def test_sniffing_reads_whole_texts(spark):
    late = A.pack([(f"pad{i}.txt", b"z" * 900) for i in range(30)] + [("word/document.xml", b"<w/>")], "zip")
    cases = {"docx": late, "zip": A.pack([("password/a.txt", b"1")], "zip"), "csv": CSV.encode(),
             "prose": ("a,b\n" * 40 + "then prose goes on, and on, with commas, for long\n" * 60).encode(),
             "json": b'{"v": "' + b"a" * 20_500_000 + b'"}', "broken": b'{"v": "' + b"a" * 20_500_000}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "k string, content binary")
    got = {r.k: (r.route, r.kind) for r in S.with_route(df, "content", "route", "kind").select("k", "route", "kind").collect()}
    assert got["docx"] == ("office", "docx") and got["zip"] == ("archive", "zip") and got["csv"][0] == "csv"
    assert got["prose"][0] == "markdown" and got["json"][0] == "json" and got["broken"][0] == "markdown"


def test_csv_files_with_other_columns_are_read_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n" + "".join(f"{i};a{i}\n" for i in range(6)))
    (tmp_path / "b.csv").write_text("y;x;z\n" + "".join(f"b{i};{i};q\n" for i in range(6)))
    got = {tuple(df.columns[:-1]): df.collect() for c, df in read_cascade(spark, str(tmp_path)) if c["format"] == "csv"}
    assert set(got) == {("x", "y"), ("y", "x", "z")}
    assert all(r.y.startswith("a") for r in got[("x", "y")]) and all(r.y.startswith("b") for r in got[("y", "x", "z")])
