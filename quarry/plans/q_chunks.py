"""Queries: hashing, dedup, chunk split, chunk table, ordinals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_sha256
from ..operators.chunking import dedup_files, distinct_chunks, file_chunks
from ..operators.store import write_staged
from .registry import register
from .sql import chunks_cte
from .tables import read


def chunk_rows(spark, sf_dir, target=4000):
    docs = read(spark, sf_dir, "documents")
    return file_chunks(dedup_files(docs), target=target)


@register("str_4_chunks", f"""
WITH f AS (SELECT sha256(text) AS file_sha256, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),
{chunks_cte('f')}
SELECT file_sha256, idx, chunk_sha256, CAST(length(markdown) AS BIGINT) AS n_chars FROM fc""")
def str_4_chunks(spark, sf_dir):
    """Flagship: documents → hash → exact dedup → split (4000) → chunk hash → ordinals."""
    return (chunk_rows(spark, sf_dir)
            .select("file_sha256", F.col("idx").cast("bigint").alias("idx"), "chunk_sha256",
                    F.length("markdown").cast("bigint").alias("n_chars")))


@register("str_4_chunks_small", f"""
WITH f AS (SELECT sha256(text) AS file_sha256, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),
{chunks_cte('f', target=300)}
SELECT file_sha256, idx, chunk_sha256, markdown FROM fc""")
def str_4_chunks_small(spark, sf_dir):
    """Chunk split at target 300 (exercises every separator level), full chunk text."""
    return (chunk_rows(spark, sf_dir, target=300)
            .select("file_sha256", F.col("idx").cast("bigint").alias("idx"), "chunk_sha256", "markdown"))


@register("src_1_hash", """
SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents""")
def src_1_hash(spark, sf_dir):
    """Content address of every document: SHA-256 hex of its UTF-8 bytes."""
    d = read(spark, sf_dir, "documents")
    b = F.encode("text", "UTF-8")
    return d.select("doc_id", content_sha256(b).alias("sha256"), F.octet_length(b).cast("bigint").alias("n_bytes"))


@register("agg_1_dedup", """
SELECT sha256(text) AS sha256, count(*) AS n_copies, min(doc_id) AS first_doc_id,
       count(DISTINCT source) AS n_sources
FROM documents GROUP BY 1""")
def agg_1_dedup(spark, sf_dir):
    """Exact file dedup by content hash with provenance counts."""
    d = read(spark, sf_dir, "documents")
    return (d.groupBy(content_sha256(F.col("text")).alias("sha256"))
             .agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_doc_id"),
                  F.countDistinct("source").alias("n_sources")))


@register("agg_2_chunk_dedup", f"""
WITH f AS (SELECT sha256(text) AS file_sha256, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),
{chunks_cte('f')}
SELECT chunk_sha256 AS sha256, count(*) AS n_refs, CAST(any_value(length(markdown)) AS BIGINT) AS n_chars
FROM fc GROUP BY 1""")
def agg_2_chunk_dedup(spark, sf_dir):
    """Chunk table: distinct chunks across files with their reference counts."""
    c = distinct_chunks(write_staged(chunk_rows(spark, sf_dir), "file-chunks"))
    return c.select("sha256", "n_refs", F.length("markdown").cast("bigint").alias("n_chars"))


@register("str_5_chunk_hash", f"""
WITH f AS (SELECT sha256(text) AS file_sha256, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),
{chunks_cte('f')}
SELECT count(*) AS n_chunks, count(DISTINCT chunk_sha256) AS n_distinct,
       count(*) FILTER (WHERE markdown = '') AS n_empty,
       CAST(sum(length(markdown)) AS BIGINT) AS total_chars,
       CAST(max(length(markdown)) AS BIGINT) AS max_chars
FROM fc""")
def str_5_chunk_hash(spark, sf_dir):
    """Chunk statistics: count, distinct hashes, empty chunks, total and max size."""
    c = chunk_rows(spark, sf_dir)
    return c.agg(F.count(F.lit(1)).alias("n_chunks"),
                 F.countDistinct("chunk_sha256").alias("n_distinct"),
                 F.count_if(F.col("markdown") == "").alias("n_empty"),
                 F.sum(F.length("markdown")).cast("bigint").alias("total_chars"),
                 F.max(F.length("markdown")).cast("bigint").alias("max_chars"))


@register("win_2_ordinals", f"""
WITH f AS (SELECT sha256(text) AS file_sha256, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),
{chunks_cte('f')}
SELECT file_sha256, count(*) AS n_chunks, CAST(max(idx) AS BIGINT) AS max_idx, CAST(min(idx) AS BIGINT) AS min_idx
FROM fc GROUP BY 1""")
def win_2_ordinals(spark, sf_dir):
    """Chunk ordinals per file: 0-based, dense (max = count - 1)."""
    c = chunk_rows(spark, sf_dir)
    return c.groupBy("file_sha256").agg(F.count(F.lit(1)).alias("n_chunks"),
                                        F.max("idx").cast("bigint").alias("max_idx"),
                                        F.min("idx").cast("bigint").alias("min_idx"))
