"""The corpus pipeline on a small folder of tables."""

import corpus_pipeline
from quarry.llm import decontaminate, language_id, line_spread, mixing, weighted_minhash
from tests.conftest import SF001
from tests.llm.data import edge_docs, empty_docs


def test_stage_names_and_columns(spark):
    docs = edge_docs(spark, False)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, empty_docs(spark)):
            out = stage(spark, table, SF001)
            assert set(docs.columns) <= set(out.columns) if k == 4 else out.columns == docs.columns, name
            assert table is docs or out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix"]


def test_run_equals_the_operators_in_turn(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    known = {r.doc_id for r in language_id.predict_languages(docs).where("lang_pred <> 'und' AND score >= 0.3").collect()}
    one = docs.where(docs.doc_id.isin(list(known)))
    two = line_spread.dedup_lines(one).where("n_removed = 0 OR n_removed < n_lines").select(*docs.columns)
    first = {r.doc_id for r in weighted_minhash.near_duplicates(two).collect() if r.doc_id == r.class_id}
    three = two.where(two.doc_id.isin(list(first)))
    bad = {r.doc_id for r in decontaminate.decontaminate(three, spark.read.parquet(f"{SF001}/benchmark.parquet")).collect() if r.contaminated}
    four = three.where(~three.doc_id.isin(list(bad)))
    want = {(r.doc_id, r.taken) for r in mixing.mix_sources(four).collect() if r.taken}
    assert {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SF001).collect()} == want and want
