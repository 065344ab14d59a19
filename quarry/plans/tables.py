"""Driver tables and the engine tables derived from them.

The driver ships TPC-H-like tables plus ``documents``, ``pages``, ``events``,
``embeddings``, ``conversations``, ``benchmark`` and ``labels``.  The engine's
own tables (files, sources, url_files, file_files, chunks, file_chunks) are
derived here with plain DataFrame expressions so every query's work grows
with the input tables.  The same derivations are restated in SQL by the
oracle (``quarry.plans.sql``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_sha256

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed clock for every age / TTL computation (never the wall clock in queries).
AS_OF = "2024-03-01 00:00:00"
# Base instant from which synthetic lifecycle timestamps are derived.
EPOCH = "2024-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ts_ntz(base: str) -> F.Column:
    return F.expr(f"TIMESTAMP_NTZ'{base}'")


def ts_plus_seconds(base: str, secs) -> F.Column:
    """``base + secs`` seconds as TIMESTAMP_NTZ (independent of session time zone)."""
    return F.timestamp_add("SECOND", secs, ts_ntz(base))


def epoch_seconds(ts) -> F.Column:
    """Seconds since 1970-01-01 of an NTZ timestamp, as BIGINT."""
    return F.timestamp_diff("SECOND", ts_ntz("1970-01-01 00:00:00"), ts).cast("bigint")


def files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(sha256, markdown, created_at, parsed_at, indexed_at) from documents ⟕ labels.

    One row per distinct text.  ``labels`` present ⇒ parsed, ``quality = 1`` ⇒
    indexed.  Timestamps derive from the lowest doc_id holding the text.
    """
    return (file_states(spark, sf_dir)
            .join(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown")), "doc_id")
            .select("sha256", "markdown", "doc_id", "created_at", "parsed_at", "indexed_at"))


def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files_table`` without the texts: only hash keys, ids and labels move."""
    docs = read(spark, sf_dir, "documents").select("doc_id", content_sha256(F.col("text")).alias("sha256"))
    lab = read(spark, sf_dir, "labels").select("doc_id", "quality")
    one = docs.groupBy("sha256").agg(F.min("doc_id").alias("doc_id")).join(lab, "doc_id", "left")
    start = F.col("doc_id") * 60
    return one.select("sha256", "doc_id", ts_plus_seconds(EPOCH, start).alias("created_at"),
                      F.when(F.col("quality").isNotNull(), ts_plus_seconds(EPOCH, start + 30)).alias("parsed_at"),
                      F.when(F.col("quality") == 1, ts_plus_seconds(EPOCH, start + 45)).alias("indexed_at"))


def sources_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sources(source, source_id, file_sha256, created_at, touched_at): one per document."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("source"),
        F.col("doc_id").cast("string").alias("source_id"),
        content_sha256(F.col("text")).alias("file_sha256"),
        ts_plus_seconds(EPOCH, F.col("doc_id") * 60).alias("created_at"),
        ts_plus_seconds(EPOCH, F.col("doc_id") * 3600).alias("touched_at"))


def url_files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url_files(url, resolved_url, file_sha256, fetched_at) from pages."""
    p = read(spark, sf_dir, "pages")
    return p.select("url", F.col("url").alias("resolved_url"),
                    content_sha256(F.col("html")).alias("file_sha256"),
                    ts_plus_seconds(EPOCH, F.col("page_id") * 1800).alias("fetched_at"))


def file_files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_files(parent_sha256, child_sha256, turn) from conversations:
    a conversation is the parent file, each turn text a child file."""
    c = read(spark, sf_dir, "conversations")
    return c.select(content_sha256(F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))).alias("parent_sha256"),
                    content_sha256(F.col("text")).alias("child_sha256"),
                    F.col("turn"))
