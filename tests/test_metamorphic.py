import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import store as S
from quarry.operators.chunking import dedup_files, file_chunks
from tests.conftest import SF001
from tests.rules import check_chunks

WS = re.compile(r"\s")


def test_chunks_reassemble_to_text(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    files = dedup_files(docs)
    fc = file_chunks(files, target=500)
    got = {r.file_sha256: r.t for r in fc.groupBy("file_sha256").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "markdown"))), lambda x: x["markdown"]),
                     "").alias("t")).collect()}
    for r in files.collect():
        assert WS.sub("", got[r.sha256]) == WS.sub("", r.markdown)


def test_reingest_is_noop(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    fc = file_chunks(dedup_files(docs)).select("chunk_sha256").distinct()
    again = S.insert_if_absent(fc, fc, ["chunk_sha256"])
    assert again.count() == fc.count()
    a = sorted(r[0] for r in file_chunks(dedup_files(docs)).select("chunk_sha256").collect())
    b = sorted(r[0] for r in file_chunks(dedup_files(docs)).select("chunk_sha256").collect())
    assert a == b


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab #.\n\t\x1c　é😀")), max_size=120), min_size=1, max_size=20),
       st.integers(min_value=3, max_value=40))
def test_split_property(spark, texts, target):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.c) for r in df.select("i", T.split_markdown(F.col("t"), target).alias("c")).collect()}
    for i, t in enumerate(texts):
        check_chunks(t, got[i], target)
