"""Queries run as Structured Streaming jobs (availableNow over a landing
folder written from the driver tables): continuous ingest, content dedup
within a watermark, per-URL fetch throttling, streamed readiness, the slow
backlog lane and restart after a failed batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import content_sha256
from ..operators.search import hash_embed
from ..session import scratch_path
from ..streaming import ingest as ST
from .registry import register
from .sql import chunks_cte
from .tables import read, ts_ntz

EPOCH0 = "1970-01-01 00:00:00"


#: Rows of a landed file (a task's share); micro-batches that a run is taken in.
ROWS_PER_FILE, BATCHES = 25_000, 4


def _land(df, spark, name):
    """(landing folder, files per micro-batch): the number of files follows the
    number of rows, the number of micro-batches does not."""
    path = scratch_path(spark, name)
    files = max(BATCHES, -(-df.count() // ROWS_PER_FILE))
    df.repartition(files).write.parquet(path)
    return path, -(-files // BATCHES)


def _land_in_order(df, spark, name, ts, arrivals=BATCHES):
    """(landing folder, files per arrival): it fills in ``arrivals`` steps of event
    time, written in order; each has the same number of files, which follows the
    number of rows, so that a micro-batch takes one whole arrival."""
    path = scratch_path(spark, name)
    files = max(1, -(-df.count() // (arrivals * ROWS_PER_FILE)))
    at = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts).cast("timestamp_ntz")).cast("double")
    cuts = sorted(set(df.select(at.alias("t")).approxQuantile("t", [i / arrivals for i in range(1, arrivals)], min(0.001, 0.1 / arrivals))))
    step = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: F.coalesce(at > c, F.lit(False))))
    sliced = scratch_path(spark, f"{name}-sliced")
    df.withColumn("step", step).write.partitionBy("step").parquet(sliced)
    slices = spark.read.schema(StructType([*df.schema.fields, StructField("step", IntegerType())])).parquet(sliced)
    for i in range(len(cuts) + 1):
        arrival = f"{path}/arrival_{i}"
        slices.filter(F.col("step") == i).drop("step").repartition(files).write.parquet(arrival)
        # a part without rows leaves no file: empty files make up the number
        for _ in range(files - len(spark.read.schema(df.schema).parquet(arrival).inputFiles())):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(arrival)
    return path, files


def _close(spark, path, row, schema):
    """A last arrival far in the future: the watermark passes all before it."""
    spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{path}/closing")


def _arrivals(spark, path, schema, files):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path))


def _ingest(spark, sf_dir, lose_batch=None):
    """Ingest over several micro-batches; with ``lose_batch`` that batch fails
    once after its write, and the query is started again from its checkpoint."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    src, files = _land(d, spark, "landing-docs")
    table, ckpt = scratch_path(spark, "files-table"), scratch_path(spark, "ingest-ckpt")

    def start(sink):
        return ST.ingest_stream(spark, src, "doc_id bigint, text string", "text", table, ckpt, max_files_per_trigger=files, sink=sink)
    sink = ST.new_rows_sink(table)
    if lose_batch is not None:
        lost = []

        def failing(batch, batch_id):
            sink(batch, batch_id)
            if batch_id == lose_batch:
                lost.append(batch_id)
                raise RuntimeError("lost after the write")
        q = start(failing)
        try:
            q.awaitTermination()
        except Exception:
            if not lost:       # another failure than the injected one
                raise
    start(sink).awaitTermination()
    return spark.read.parquet(table)


@register("stm_1_ingest", """
SELECT DISTINCT sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS n_chars FROM documents""")
def stm_1_ingest(spark, sf_dir):
    """Continuous ingest: documents arrive as files, four micro-batches merge
    into the content-addressed files table (anti join, per-batch overwrite)."""
    t = _ingest(spark, sf_dir)
    return t.select("sha256", F.length("markdown").cast("bigint").alias("n_chars"))


@register("stm_6_recovery", """
SELECT DISTINCT sha256(text) AS sha256 FROM documents""")
def stm_6_recovery(spark, sf_dir):
    """Crash recovery: batch 1 fails after writing; the restarted query
    replays it from the checkpoint without duplicating any file."""
    return _ingest(spark, sf_dir, lose_batch=1).select("sha256")


@register("stm_2_dedup", """SELECT DISTINCT sha256(props) AS sha256 FROM events""")
def stm_2_dedup(spark, sf_dir):
    """Stream dedup by content (event payload hash): a one-hour watermark bounds
    the state, an anti join against the rows written so far drops later repeats."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "props")
    src, files = _land_in_order(e, spark, "landing-events", "ts")
    s = _arrivals(spark, src, "event_id bigint, ts timestamp, props string", files)
    out = ST.run_new_rows(ST.dedup_stream(s, content_sha256(F.col("props")), "ts", "1 hour"), "dedup", spark)
    return out.select("sha256")


@register("stm_3_throttle", """
WITH RECURSIVE ev AS (SELECT 'https://p.example/' || user_id AS url, ts FROM events WHERE event_type = 'view'),
acc(url, ts) AS (SELECT url, min(ts) FROM ev GROUP BY url
  UNION ALL SELECT e.url, min(e.ts) FROM acc a JOIN ev e ON e.url = a.url AND e.ts >= a.ts + INTERVAL 6 HOUR GROUP BY e.url)
SELECT ev.url, epoch_us(ev.ts) AS ts_us, ev.ts IN (SELECT ts FROM acc WHERE acc.url = ev.url) AS accepted FROM ev""")
def stm_3_throttle(spark, sf_dir):
    """URL freshness in a stream: a view-fetch of a page is accepted only when
    the page's last accepted fetch is at least 6 hours old, decided in event time
    once the watermark has passed (state per URL)."""
    e = (read(spark, sf_dir, "events").filter(F.col("event_type") == "view")
         .select(F.concat(F.lit("https://p.example/"), F.col("user_id").cast("string")).alias("url"), "ts"))
    src, files = _land_in_order(e, spark, "landing-fetches", "ts")
    _close(spark, src, ("", datetime(2200, 1, 1)), "url string, ts timestamp_ntz")
    s = _arrivals(spark, src, "url string, ts timestamp_ntz", files)
    out = ST.run_to_table(ST.fetch_throttle(s, 6 * 3600, delay="1 hour"), "throttle", spark).where("url <> ''")
    us = F.timestamp_diff("MICROSECOND", ts_ntz(EPOCH0), F.col("ts"))
    return out.select("url", us.alias("ts_us"), "accepted")


@register("stm_4_readiness", """
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS parent, sha256(text) AS child, length(text) % 5 <> 0 AS parsed FROM conversations),
e AS (SELECT parent, count(DISTINCT child) AS expected FROM c GROUP BY 1),
s AS (SELECT parent, count(DISTINCT child) AS n_seen FROM c WHERE parsed GROUP BY 1)
SELECT e.parent, true AS ready, s.n_seen, e.expected AS n_expected FROM e JOIN s USING (parent) WHERE s.n_seen >= e.expected""")
def stm_4_readiness(spark, sf_dir):
    """Readiness in a stream: a conversation (parent) is emitted once every
    one of its distinct turn files has been parsed."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("parent"),
                                                     content_sha256(F.col("text")).alias("child"),
                                                     (F.length("text") % 5 != 0).alias("parsed"))
    exp = c.groupBy("parent").agg(F.countDistinct("child").alias("expected"))
    note = c.filter("parsed").join(exp, "parent").select("parent", "child", "expected")
    src, files = _land(note, spark, "landing-parsed")
    s = _arrivals(spark, src, "parent string, child string, expected bigint", files)
    return ST.run_to_table(ST.readiness_stream(s), "ready", spark)


@register("stm_5_backlog", """
WITH f AS (SELECT sha256(text) AS file_sha256, arg_min(text, doc_id) AS text, min(doc_id) AS first_doc_id FROM documents GROUP BY 1),
""" + chunks_cte("f").strip() + """,
c AS (SELECT fc.chunk_sha256 AS sha256, min(f.first_doc_id) AS first_doc_id FROM fc JOIN f USING (file_sha256) GROUP BY 1)
SELECT sha256, 64::BIGINT AS dim FROM c WHERE first_doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def stm_5_backlog(spark, sf_dir):
    """Two-speed processing: the slow lane embeds the queued chunks without a
    vector in one availableNow run."""
    from .q_lifecycle import _chunk_queue
    from ..operators.chunking import dedup_files, distinct_chunks, file_chunks
    from ..operators.store import write_staged
    # split once, for the queue and for the texts
    fc = write_staged(file_chunks(dedup_files(read(spark, sf_dir, "documents"))), "file-chunks")
    chunks = _chunk_queue(spark, sf_dir, fc).filter(F.col("embedding").isNull()).select("sha256")
    queued = write_staged(chunks.join(distinct_chunks(fc).select("sha256", "markdown"), "sha256"), "queued")
    queue, files = _land(queued, spark, "queue")
    out = ST.backlog_once(spark, queue, "sha256 string, markdown string",
                          lambda s: s.select("sha256", hash_embed(F.col("markdown")).alias("embedding")), max_files_per_trigger=files)
    return out.select("sha256", F.size("embedding").cast("bigint").alias("dim"))
