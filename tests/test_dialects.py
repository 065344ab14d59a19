"""CSV dialects: expectations written by hand, and files read back."""

import csv
import io

from pyspark.sql import functions as F

from quarry.functions import sniff as S
from quarry.functions.tables import csv_rows
from quarry.sources import formats as FM

CASES = [
    ("id,name\n1,'a, b'\n2,'it''s, c'\n3,'d,e'\n4,'f,g'\n", (",", "'", "")),
    ('id;name\n1;"a; ""b"""\n2;"c"\n3;"d;e"\n4;"f;;g"\n', (";", '"', "")),
    ('1,"a \\"b\\", c"\n2,"d, e"\n3,"f"\n4,"g \\"h\\""\n5,"i, j"\n', (",", '"', "\\")),
    ("1|'a\\'b|c'\n2|'d|e'\n3|'f'\n4|'g\\'|'\n5|'h|i'\n", ("|", "'", "\\")),
    ("a\tb\n1\t2\n3\t4\n5\t6\n7\t8\n", ("\t", "", "")),
    ("x;y,z\n1;2,5\n2;3,5\n3;4,5\n4;5,5\n", (";", "", "")),      # as many fields either way: the earlier delimiter's score decides by its cells
    ("path,n\nC:\\tmp,1\nC:\\new,2\nD:\\x,3\nE:\\y,4\n", (",", "", "")),
    ("one line, two\n", None), ("no delimiter\nat all\nin these\nfive\nlines\n", None), ("", None), (None, None),
    ("Don't stop, she said\nIt's fine\nwe 'll see\nand so on, and on, and on\nlast, one\n", None),
    ('1,"two\nlines"\n2,"x"\n3,"y"\n4,"z"\n5,"w"\n', (",", '"', "")),
]


def test_dialects_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string").select("i", S.csv_dialect(F.col("t")).alias("d"))
    got = {r.i: r.d and (r.d.delimiter, r.d.quote, r.d.escape) for r in df.collect()}
    for i, (text, want) in enumerate(CASES):
        if i != 5:
            assert got[i] == want, (text, got[i])
    assert got[5] is not None and got[5][0] in ",;"


def test_routes_of_quoted_texts(spark):
    rows = [(i, bytearray(t.encode())) for i, (t, w) in enumerate(CASES) if t and w]
    df = spark.createDataFrame(rows, "i int, content binary")
    assert {r.route for r in S.with_route(df).collect()} == {"csv"}


def test_quoted_files_read_back(spark, tmp_path):
    want = [(i, f"n{i}, 'q' \"d\" ; | x") for i in range(8)]
    for k, (d, quote, escape) in enumerate([(",", '"', ""), (";", "'", ""), (",", '"', "\\"), ("|", "'", "\\")]):
        folder = tmp_path / f"f{k}"
        folder.mkdir()
        out = io.StringIO()
        how = {"escapechar": escape, "doublequote": False} if escape else {"doublequote": True}
        csv.writer(out, delimiter=d, quotechar=quote, quoting=csv.QUOTE_NONNUMERIC, lineterminator="\n", **how).writerows([("id", "text"), *want])
        (folder / "a.csv").write_text(out.getvalue())
        [(dialect, df)] = FM.read_cascade(spark, str(folder))
        assert dialect["dialect"] == {"delimiter": d, "quote": quote, "escape": escape, "multiline": False} and dialect["header"]
        assert sorted((r["id"], r["text"]) for r in df.collect()) == want
        assert csv_rows(out.getvalue(), dialect["dialect"]) == (["id", "text"], [[str(i), t] for i, t in want])


def test_a_line_break_in_a_field_is_read(spark, tmp_path):
    (tmp_path / "m.csv").write_text(CASES[-1][0])
    [(dialect, df)] = FM.read_cascade(spark, str(tmp_path))
    assert dialect["dialect"]["multiline"] and {r[1] for r in df.collect()} == {"two\nlines", "x", "y", "z", "w"}
