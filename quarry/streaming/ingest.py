"""Structured Streaming forms of the ingest lifecycle.

* ``ingest_stream``: files/requests arrive as a stream; each micro-batch's new
  hashes (anti join against the table so far) are written by ``foreachBatch``
  into a ``batch_id=<n>`` folder with overwrite, so a replayed batch (after a
  crash) rewrites the same rows instead of adding duplicates.
* ``dedup_stream``: content dedup within an event-time watermark, completed by
  the same sink for what repeats or arrives later.
* ``fetch_throttle``: at most one accepted fetch per URL per ``max_age``, decided
  in event time.
* ``readiness_stream``: a parent is emitted when its last expected child
  has been parsed, with a timeout that reports parents still incomplete.
* ``backlog_once``: the slow lane, an ``availableNow`` run over the queue.

Streams read Parquet folders (the cluster's landing zone); checkpoints live
under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_sha256
from ..session import ensure_checkpoint_dir, scratch_path
from .state import dedup_stream, fetch_throttle, readiness_stream  # noqa: F401


def new_rows_sink(table_dir: str, key: str = "sha256"):
    """foreachBatch sink: of a micro-batch, the rows whose key no earlier batch
    has written go to the batch's own ``batch_id=<n>`` folder with overwrite.  A
    replayed batch looks at earlier folders only and rewrites the same rows."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates([key])
        if batch_id > 0:
            before = batch.sparkSession.read.parquet(table_dir).filter(F.col("batch_id") < batch_id)
            rows = rows.join(before.select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{table_dir}/batch_id={batch_id}")
    return run


def ingest_stream(spark: SparkSession, source_dir: str, schema: str, text_col: str, table_dir: str,
                  checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                  existing: DataFrame | None = None, sink=None):
    """Start the continuous ingest; returns the StreamingQuery (availableNow).

    Content dedup is an anti join of each micro-batch's hashes against the
    table written so far, so the stream keeps no state that grows.  ``existing``
    (sha256 of files ingested before this stream started) is excluded with a
    stream-static anti join.  ``sink`` replaces the foreachBatch function."""
    ensure_checkpoint_dir(spark)
    checkpoint = checkpoint or scratch_path(spark, "ingest-ckpt")
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    src = r.parquet(source_dir)
    rows = src.select(content_sha256(F.col(text_col)).alias("sha256"), F.col(text_col).alias("markdown"))
    if existing is not None:
        rows = rows.join(existing.select("sha256").distinct(), "sha256", "left_anti")
    return (rows.writeStream.foreachBatch(sink or new_rows_sink(table_dir))
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())


def run_new_rows(df: DataFrame, name: str, spark: SparkSession, key: str = "sha256") -> DataFrame:
    """Run a streaming frame to completion into a table with one row per key."""
    ensure_checkpoint_dir(spark)
    out = scratch_path(spark, name)
    q = (df.writeStream.foreachBatch(new_rows_sink(out, key)).option("checkpointLocation", out + "-ckpt")
           .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


def run_to_table(df: DataFrame, name: str, spark: SparkSession) -> DataFrame:
    """Run a streaming frame to completion (availableNow) into Parquet under
    the checkpoint folder and return what it wrote."""
    ensure_checkpoint_dir(spark)
    out = scratch_path(spark, name)
    q = (df.writeStream.format("parquet").option("path", out)
           .option("checkpointLocation", out + "-ckpt").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def backlog_once(spark: SparkSession, queue_dir: str, schema: str, fn, name: str = "backlog",
                 max_files_per_trigger: int = 1000) -> DataFrame:
    """The slow lane: process whatever is queued now (availableNow) with
    ``fn`` (a DataFrame → DataFrame enrichment) and return its output."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(queue_dir)
    return run_to_table(fn(s), name, spark)
