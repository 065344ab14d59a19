import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from tests.rules import check_chunks

from tests.conftest import SF01


def _split(spark, texts, target):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.split_markdown(F.col("t"), target).alias("c")).collect()
    return {r.i: list(r.c) for r in rows}


@pytest.mark.parametrize("target", [4000, 300])
def test_split_matches_rule_on_documents(spark, target):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: list(r.c) for r in
           docs.select("doc_id", T.split_markdown(F.col("text"), target).alias("c")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for d, t in texts.items():
        check_chunks(t, got[d], target)


def test_split_edge_cases(spark):
    cases = ["  short  ", "\n" + "a" * 5000, "x" * 10 + "\x1c", "\x1c" + "b " * 3000,
             "# h\n" + "w " * 2500 + "\n# h2\n" + "v. " * 1500]
    got = _split(spark, cases, 4000)
    assert got[0] == ["  short  "]
    assert got[1] == ["", "a" * 5000]
    for i, c in enumerate(cases[2:], 2):
        check_chunks(c, got[i], 4000)


def test_split_cuts_by_hand(spark):
    got = _split(spark, ["aa bb cc dd", "one. two. three", "x\n\ny\n\nz", "p\n# q\n# r", "a\n\n\nb cdef"], 5)
    assert got == {0: ["aa bb", "cc", "dd"], 1: ["one.", "two.", "three"], 2: ["x\n\ny", "z"], 3: ["p\n# q", "# r"], 4: ["a\n\n\nb", "cdef"]}


def test_split_keeps_control_characters(spark):
    text = "\u0001" * 900 + " " + "word \u0001" * 900
    got = _split(spark, [text], 4000)[0]
    assert "".join(got).count("\u0001") == 1800 and max(map(len, got)) <= 4000


def test_split_adversarial_random(spark):
    rnd = random.Random(7)
    alphabet = ["a", "b", " ", "  ", "\n", "\n\n", "#", ". ", "\x1c", "　", "é", "😀", "\t", "\x0b"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))) for _ in range(600)]
    for target in (5, 17, 40):
        got = _split(spark, texts, target)
        for i, t in enumerate(texts):
            check_chunks(t, got[i], target)


def test_linkify_and_links(spark):
    cases = ["see https://a.b/c", "[x](https://q.r) and \"http://z\"", "[https://a](https://a)",
             "HTTP://UP.CASE/x.", "(http://in.paren) tail http://t/ü?q=1", "[a](u1) ![b](u2) [](u3)"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    rows = df.select(T.linkify(F.col("t")).alias("l"), T.extract_links(F.col("t")).alias("x")).collect()
    assert rows[3].l == "[HTTP://UP.CASE/x.](HTTP://UP.CASE/x.)"
    assert rows[4].l == "(http://in.paren) tail [http://t/ü?q=1](http://t/ü?q=1)"
    assert rows[0].l == "see [https://a.b/c](https://a.b/c)"
    assert rows[1].l == cases[1]
    assert rows[2].l == "[[https://a](https://a)](https://a)"
    assert list(rows[5].x) == ["u1", "u2", "u3"]


def test_normalize_text(spark):
    df = spark.createDataFrame([(bytearray(b"\xe9\r\n"),), (bytearray("ok\r\rz".encode()),)], "b binary")
    got = [r.t for r in df.select(T.normalize_text(F.col("b")).alias("t")).collect()]
    assert got == ["é\n", "ok\n\nz"]


def test_links_come_from_the_document(spark):
    from quarry.plans.q_text import _with_urls
    from tests.conftest import SF001
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = d.select(_with_urls().alias("md")).select("md", T.linkify(F.col("md")).alias("l"), T.extract_links(F.col("md")).alias("x")).collect()
    for r in rows:
        at = 0
        for x in r.x:
            at = r.md.index(f"]({x})", at) + 1
        assert len(r.l) >= len(r.md)
