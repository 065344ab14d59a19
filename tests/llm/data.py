"""Small tables with the awkward rows that every operator must take."""

import re
import zlib

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHING = ("rid", "score", "n", "h", "a", "b", "size", "taken", "target", "lang_pred", "n_lines", "n_removed", "class_id", "row", "key", "salt",
            "held_out", "kept", "Refers_To", "gone", "label", "t", "pos")
LONG = " ".join(f"long{i % 977}" for i in range(60000))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def held(doc_id, mod, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == rest


EDGE_ROWS = [
    (1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \n\t ", "fr", "s2"), (4, "### 123 !!!", None, None), (5, LONG, "en", "s2"),
    (6, "one two three", "de", "s1"), (7, "the same row twice in the table", "en", "s3"), (7, "the same row twice in the table", "en", "s3"),
    (None, "a row without an id but with words", "en", "s3"), (8, "Ünïcödé \u0001 wörds here", "de", ""), (9, "x", None, "s1"),
    (10, "line one\nline two\nline one\n\nline two", "en", "s2"),
]


def edge_docs(spark, clashing=True):
    df = spark.createDataFrame([(i, t, v, s, len(t or "")) for i, t, v, s in EDGE_ROWS], DOC_SCHEMA)
    if clashing:
        df = df.selectExpr("*", *[f"'extra' AS `{c}`" for c in CLASHING])
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
