"""Content-addressed files → ordered, deduplicated chunks.

Dedup happens *before* splitting so each distinct text is split once; only
hash keys are aggregated, and no text sits in an aggregation buffer but the
first copy of a repeated one.  Splitting is a
per-row Column expression (no shuffle, no Python).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_sha256, split_column
from ..session import CHUNK_TARGET


def dedup_files(df: DataFrame, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    """Exact dedup by content hash; the representative is the lowest ``order_col``.

    Output: sha256, markdown, n_copies, first_<order_col>.  Only (hash, order)
    keys are aggregated.  Texts that occur once pass an anti join against the
    keys of the repeated ones; only the first copies of those are grouped.
    Null texts are no files."""
    rows = df.filter(F.col(text_col).isNotNull()).select(content_sha256(F.col(text_col)).alias("sha256"), F.col(text_col).alias("markdown"),
                                                         F.col(order_col).alias("_o"))
    first = f"first_{order_col}"
    repeated = rows.select("sha256", "_o").groupBy("sha256").agg(F.count(F.lit(1)).alias("n_copies"), F.min("_o").alias(first)).filter("n_copies > 1")
    single = (rows.join(repeated.select("sha256"), "sha256", "left_anti")
              .select("sha256", "markdown", F.lit(1).cast("bigint").alias("n_copies"), F.col("_o").alias(first)))
    again = repeated.withColumnRenamed("sha256", "_s")
    heads = (rows.join(again, (F.col("sha256") == F.col("_s")) & F.col("_o").eqNullSafe(F.col(first)))
             .select("sha256", "markdown", "n_copies", first).dropDuplicates(["sha256"]))
    return single.unionByName(heads)


def file_chunks(files: DataFrame, target: int = CHUNK_TARGET, sha_col: str = "sha256",
                md_col: str = "markdown", keep_empty: bool = True) -> DataFrame:
    """Ordered chunk rows per file: file_sha256, idx (0-based), chunk_sha256, markdown."""
    staged = split_column(files.select(F.col(sha_col).alias("file_sha256"), F.col(md_col).alias("_md")),
                          "_md", "_chunks", target)
    # posexplode_outer: the inner form makes Catalyst infer a size(...) > 0
    # filter that re-evaluates the whole split below the projection
    out = (staged.select("file_sha256", F.posexplode_outer("_chunks").alias("idx", "markdown"))
                 .filter(F.col("idx").isNotNull())
                 .withColumn("chunk_sha256", content_sha256(F.col("markdown"))))
    if not keep_empty:
        out = out.filter(F.col("markdown") != "")
    return out.select("file_sha256", "idx", "chunk_sha256", "markdown")


def distinct_chunks(fc: DataFrame) -> DataFrame:
    """Chunk table: one row per chunk hash with the number of file places using
    it.  Only keys are aggregated; the text comes from the first place (file,
    ordinal) by a join on it.  ``fc`` is read twice: stage a costly one first."""
    first = (fc.groupBy("chunk_sha256").agg(F.count(F.lit(1)).alias("n_refs"), F.min(F.struct("file_sha256", "idx")).alias("_at"))
             .select("n_refs", F.col("_at.file_sha256").alias("_f"), F.col("_at.idx").alias("_i")))
    rows = fc.join(first, (F.col("file_sha256") == F.col("_f")) & (F.col("idx") == F.col("_i")))
    return rows.select(F.col("chunk_sha256").alias("sha256"), "markdown", "n_refs")
