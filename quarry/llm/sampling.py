"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged


def labelled_sample(rows: DataFrame, cls: str, per_class: int) -> DataFrame:
    """rows(doc_id, cls) → at most ``per_class`` of each class, the first by a
    hash of the id.  A hash threshold from the class counts leaves about twice
    the bound per class before the ranking, so no class ever meets in one task."""
    counts = staged(rows.groupBy(cls).agg(F.count(F.lit(1)).alias("class_rows")), "class-counts")
    h = F.xxhash64("doc_id")
    share = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.join(small(counts, counts.count()), cls).where(share * F.col("class_rows") <= 2.0 * per_class + 64)
    rank = F.row_number().over(Window.partitionBy(cls).orderBy(share, "doc_id"))
    return staged(near.withColumn("rank", rank).where(F.col("rank") <= per_class).select("doc_id", cls), "labelled-sample")
