"""Query: the composed ingest over archives and uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ingest import ingest
from ..operators.store import write_staged
from .q_archive import MEMBERS_SQL, archives_df
from .registry import register
from .tables import read


#: Archives hold every document and a changed copy of it, uploads the documents.
COPY = 1_000_000_000
PACKED_SQL = MEMBERS_SQL.replace("FROM documents)", f"""FROM (
  SELECT doc_id, text, source FROM documents UNION ALL SELECT doc_id + {COPY}, text || chr(10) || 'archived', source FROM documents))""")


@register("ing_1_collection", PACKED_SQL + """,
u AS (SELECT sha256(text) AS sha256, count(*) AS n_sources FROM documents GROUP BY 1),
e AS (SELECT child_sha256 AS sha256, count(*) AS n_paths, count(DISTINCT source || '/' || bucket) AS n_archives FROM m GROUP BY 1),
a AS (SELECT sha256 FROM e UNION SELECT sha256 FROM u)
SELECT a.sha256, CASE WHEN u.sha256 IS NULL THEN 1 ELSE 0 END AS generation, coalesce(n_paths, 0) AS n_paths, coalesce(n_archives, 0) AS n_archives,
       coalesce(n_sources, 0) AS n_sources
FROM a LEFT JOIN u USING (sha256) LEFT JOIN e USING (sha256)""")
def ing_1_collection(spark, sf_dir):
    """All documents uploaded, and archives of them and of changed copies, in one
    ingest: per text file its generation (1 if only archives brought it), the
    archive paths and archives that hold it, and its source rows."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    uploads = d.select("source", F.col("doc_id").cast("string").alias("source_id"), F.encode("text", "UTF-8").alias("content"))
    copies = d.select((F.col("doc_id") + COPY).alias("doc_id"), F.concat("text", F.lit("\narchived")).alias("text"), "source")
    packed = write_staged(archives_df(spark, sf_dir, d.unionByName(copies)), "archives")
    boxes = packed.select(F.lit("archive").alias("source"), F.concat_ws("/", "source", "bucket").alias("source_id"), "content")
    got = ingest(uploads.unionByName(boxes))
    files = got.files.filter(F.col("route") != "archive").select("sha256", "generation")
    paths = (got.edges.groupBy(F.col("child_sha256").alias("sha256"))
             .agg(F.count(F.lit(1)).alias("n_paths"), F.countDistinct("parent_sha256").alias("n_archives")))
    held = got.sources.groupBy(F.col("file_sha256").alias("sha256")).agg(F.count(F.lit(1)).alias("n_sources"))
    zero = F.lit(0).cast("bigint")
    return (files.join(paths, "sha256", "left").join(held, "sha256", "left")
            .select("sha256", "generation", F.coalesce("n_paths", zero).alias("n_paths"), F.coalesce("n_archives", zero).alias("n_archives"),
                    F.coalesce("n_sources", zero).alias("n_sources")))
