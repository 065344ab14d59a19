"""The registered queries of this subpackage, one per operator, each over its
whole table with production parameters, and their DuckDB restatements where SQL
can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversations, decontaminate, language_id, line_spread, mixing, neighbours, quality_rules, suffix_array, suffix_tree_lm, toxicity, warc, weighted_minhash
from .common import prepare

Builder = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weighted_minhash(spark, sf_dir):
    return weighted_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return language_id.predict_languages(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_suffix_tree_lm(spark, sf_dir):
    return suffix_tree_lm.lm_scores(_table(spark, sf_dir, "documents"))


def op5_line_spread(spark, sf_dir):
    out = line_spread.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc(spark, sf_dir):
    out = warc.round_trip(_table(spark, sf_dir, "pages"))
    broken = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.coalesce(broken.cast("long"), "refers_to").alias("refers_to"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_mixing(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix_array(spark, sf_dir):
    return suffix_array.repeated_spans(_table(spark, sf_dir, "documents"))


def op11_conversations(spark, sf_dir):
    return conversations.structure_report(_table(spark, sf_dir, "conversations"))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_neighbours(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


QUERIES: dict[str, Builder] = {
    "op1_weighted_minhash": op1_weighted_minhash,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_tree_lm": op4_suffix_tree_lm,
    "op5_line_spread": op5_line_spread,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_mixing": op9_mixing,
    "op10_suffix_array": op10_suffix_array,
    "op11_conversations": op11_conversations,
    "op12_collocations": op12_collocations,
    "op13_neighbours": op13_neighbours,
}

ORACLES: dict[str, str] = {
    "op5_line_spread": line_spread.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
