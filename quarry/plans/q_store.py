"""Queries: upserts (URL cache, sources, files, chunks), latest version per
key, chunk-set diff on re-ingest and blob put / get / delete."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_sha256
from ..operators import store as ST
from ..operators.chunking import dedup_files, file_chunks
from .registry import register
from .sql import FILES_CTE, SOURCES_CTE, URL_FILES_CTE, chunks_cte
from .tables import EPOCH, epoch_seconds, file_states, read, sources_table, ts_ntz, url_files_table

EPOCH_US = "(epoch_us({x}) // 1000000)"


@register("ups_1_url", f"""
WITH {URL_FILES_CTE.strip()},
upd AS (SELECT p.url, p.url AS resolved_url, sha256('v' || e.event_id) AS file_sha256, e.ts AS fetched_at
        FROM events e JOIN pages p ON e.user_id = p.page_id WHERE e.event_type = 'view'),
u AS (SELECT * FROM url_files UNION ALL SELECT * FROM upd)
SELECT url, arg_max(file_sha256, fetched_at) AS file_sha256, {EPOCH_US.format(x='max(fetched_at)')} AS fetched_epoch
FROM u GROUP BY 1""")
def ups_1_url(spark, sf_dir):
    """Upsert of the URL cache with newer fetches (views of a page)."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    upd = e.join(p, e["user_id"] == p["page_id"]).select(
        "url", F.col("url").alias("resolved_url"),
        content_sha256(F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("file_sha256"),
        F.col("ts").alias("fetched_at"))
    m = ST.upsert(url_files_table(spark, sf_dir), upd, ["url"], "fetched_at")
    return m.select("url", "file_sha256", epoch_seconds(F.col("fetched_at")).alias("fetched_epoch"))


@register("ups_2_source", f"""
WITH {SOURCES_CTE.strip()},
upd AS (SELECT d.source, CAST(d.doc_id AS VARCHAR) AS source_id, sha256(d.text || ' v2') AS file_sha256,
          TIMESTAMP '{EPOCH}' + to_seconds(d.doc_id * 3600 + 86400 * 40) AS created_at,
          TIMESTAMP '{EPOCH}' + to_seconds(d.doc_id * 3600 + 86400 * 40) AS touched_at
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
u AS (SELECT * FROM sources UNION ALL SELECT * FROM upd)
SELECT source, source_id, arg_max(file_sha256, touched_at) AS file_sha256,
       {EPOCH_US.format(x='min(created_at)')} AS created_epoch, {EPOCH_US.format(x='max(touched_at)')} AS touched_epoch
FROM u GROUP BY 1, 2""")
def ups_2_source(spark, sf_dir):
    """Upsert of sources on re-ingest: file re-pointed, touched_at moves, created_at stays."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    t = F.timestamp_add("SECOND", F.col("doc_id") * 3600 + 86400 * 40, ts_ntz(EPOCH))
    upd = d.select("source", F.col("doc_id").cast("string").alias("source_id"),
                   content_sha256(F.concat("text", F.lit(" v2"))).alias("file_sha256"),
                   t.alias("created_at"), t.alias("touched_at"))
    m = ST.upsert(sources_table(spark, sf_dir), upd, ["source", "source_id"], "touched_at", keep_first=("created_at",))
    return m.select("source", "source_id", "file_sha256", epoch_seconds(F.col("created_at")).alias("created_epoch"),
                    epoch_seconds(F.col("touched_at")).alias("touched_epoch"))


@register("ups_4_file", f"""
WITH {FILES_CTE.strip()},
cur AS (SELECT sha256, coalesce(parsed_at, created_at) AS v, parsed_at FROM files),
upd AS (SELECT sha256(text) AS sha256, TIMESTAMP '{EPOCH}' + to_seconds(86400 * 60 + conv_id * 60 + turn) AS v,
          TIMESTAMP '{EPOCH}' + to_seconds(86400 * 60 + conv_id * 60 + turn) AS parsed_at FROM conversations),
u AS (SELECT * FROM cur UNION ALL SELECT * FROM upd)
SELECT sha256, coalesce({EPOCH_US.format(x='arg_max(parsed_at, v)')}, -1) AS parsed_epoch FROM u GROUP BY 1""")
def ups_4_file(spark, sf_dir):
    """Upsert of files: conversation turns parsed later insert or update rows (parsed_at set)."""
    f = file_states(spark, sf_dir).select("sha256", F.coalesce("parsed_at", "created_at").alias("v"), "parsed_at")
    c = read(spark, sf_dir, "conversations")
    t = F.timestamp_add("SECOND", 86400 * 60 + F.col("conv_id") * 60 + F.col("turn"), ts_ntz(EPOCH))
    upd = c.select(content_sha256(F.col("text")).alias("sha256"), t.alias("v"), t.alias("parsed_at"))
    m = ST.upsert(f, upd, ["sha256"], "v")
    # -1 marks files not parsed yet
    return m.select("sha256", F.coalesce(epoch_seconds(F.col("parsed_at")), F.lit(-1).cast("bigint")).alias("parsed_epoch"))


@register("ups_5_chunks", """
WITH f AS (SELECT sha256(text) AS file_sha256, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),
g AS (SELECT sha256(text) AS file_sha256, any_value(text) AS text FROM conversations GROUP BY 1),
""" + chunks_cte("f").strip() + ",\n" + chunks_cte("g", name="gc").strip() + """,
old AS (SELECT DISTINCT chunk_sha256 FROM fc),
new AS (SELECT DISTINCT chunk_sha256 FROM gc)
SELECT chunk_sha256 AS sha256, CASE WHEN chunk_sha256 IN (SELECT chunk_sha256 FROM old) THEN 'existing' ELSE 'inserted' END AS origin
FROM (SELECT chunk_sha256 FROM old UNION SELECT chunk_sha256 FROM new)""")
def ups_5_chunks(spark, sf_dir):
    """Insert-if-absent of chunk rows: conversation turns chunked into the
    document chunk table; existing chunk hashes are not rewritten."""
    cur = file_chunks(dedup_files(read(spark, sf_dir, "documents"))).select(
        F.col("chunk_sha256").alias("sha256")).distinct().withColumn("origin", F.lit("existing"))
    conv = read(spark, sf_dir, "conversations").select(content_sha256(F.col("text")).alias("sha256"),
                                                       F.col("text").alias("markdown")).dropDuplicates(["sha256"])
    new = file_chunks(conv).select(F.col("chunk_sha256").alias("sha256")).withColumn("origin", F.lit("inserted"))
    return ST.insert_if_absent(cur, new, ["sha256"])


@register("win_9_latest", f"""
SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type,
       {EPOCH_US.format(x='max(ts)')} AS ts_epoch
FROM events GROUP BY 1""")
def win_9_latest(spark, sf_dir):
    """Latest version per key: newest event of each user (max_by, no sort)."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return ST.latest_by_key(e, ["user_id"], "ts").select("user_id", "event_id", "event_type",
                                                          epoch_seconds(F.col("ts")).alias("ts_epoch"))


@register("set_2_chunk_diff", """
WITH f AS (SELECT sha256(text) AS file_sha256, any_value(text) AS text FROM documents GROUP BY 1),
g AS (SELECT sha256(text) AS file_sha256, any_value(text) AS text FROM documents GROUP BY 1),
""" + chunks_cte("f").strip() + ",\n" + chunks_cte("g", target=3000, name="gc").strip() + """,
s AS (SELECT DISTINCT source, sha256(text) AS file_sha256 FROM documents),
o AS (SELECT DISTINCT s.source, fc.chunk_sha256 FROM s JOIN fc ON s.file_sha256 = fc.file_sha256),
n AS (SELECT DISTINCT s.source, gc.chunk_sha256 FROM s JOIN gc ON s.file_sha256 = gc.file_sha256),
j AS (SELECT coalesce(o.source, n.source) AS source,
        CASE WHEN o.source IS NULL THEN 'new' WHEN n.source IS NULL THEN 'gone' ELSE 'kept' END AS state
      FROM o FULL JOIN n ON o.source = n.source AND o.chunk_sha256 = n.chunk_sha256)
SELECT source, state, count(*) AS n FROM j GROUP BY 1, 2""")
def set_2_chunk_diff(spark, sf_dir):
    """Chunk-set diff per source on re-ingest with a new target size (3000):
    new, kept and gone chunks."""
    d = read(spark, sf_dir, "documents")
    files = dedup_files(d)
    src = d.select("source", content_sha256(F.col("text")).alias("file_sha256")).distinct()
    old = src.join(file_chunks(files), "file_sha256").select("source", "chunk_sha256")
    new = src.join(file_chunks(files, target=3000), "file_sha256").select("source", "chunk_sha256")
    return ST.set_diff(old, new, ["source", "chunk_sha256"]).groupBy("source", "state").agg(
        F.count(F.lit(1)).alias("n"))


@register("src_2_blobs", """
WITH store AS (SELECT DISTINCT sha256(text) AS sha256, octet_length(encode(text)) AS length FROM documents
               WHERE source <> 'src0'),
put AS (SELECT sha256, length FROM store
        UNION SELECT sha256(text), octet_length(encode(text)) FROM documents WHERE source = 'src0'),
del AS (SELECT * FROM put WHERE sha256 NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)),
keys AS (SELECT sha256(text) AS sha256, doc_id FROM documents UNION ALL SELECT sha256('missing' || doc_id), doc_id FROM labels)
SELECT k.doc_id, k.sha256, coalesce(CAST(d.length AS BIGINT), -1) AS length FROM keys k LEFT JOIN del d ON k.sha256 = d.sha256""")
def src_2_blobs(spark, sf_dir):
    """Blob store: put (insert-if-absent) documents, delete toxic-labelled
    blobs (idempotent), get every document hash plus missing keys."""
    d = read(spark, sf_dir, "documents")
    b = F.encode("text", "UTF-8")
    store = ST.BlobStore(ST.BlobStore.from_bytes(d.filter(F.col("source") != "src0").select(b.alias("content"))))
    store = store.put(ST.BlobStore.from_bytes(d.filter(F.col("source") == "src0").select(b.alias("content"))))
    tox = d.join(read(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id"), "doc_id") \
           .select(content_sha256(F.col("text")).alias("sha256"))
    store = store.delete(tox).delete(tox)
    keys = d.select(content_sha256(F.col("text")).alias("sha256"), "doc_id").unionByName(
        read(spark, sf_dir, "labels").select(
            content_sha256(F.concat(F.lit("missing"), F.col("doc_id").cast("string"))).alias("sha256"), "doc_id"))
    # a missing blob is reported with length -1
    return store.get(keys).select("doc_id", "sha256", F.coalesce(F.col("length").cast("bigint"), F.lit(-1).cast("bigint"))
                                  .alias("length"))


@register("ups_3_edges", """
WITH e AS (SELECT DISTINCT sha256('conv:' || CAST(conv_id AS VARCHAR)) AS parent_sha256, sha256(text) AS child_sha256,
                  role = 'user' AS existing FROM conversations)
SELECT parent_sha256, child_sha256, CASE WHEN bool_or(existing) THEN 'existing' ELSE 'inserted' END AS origin
FROM e GROUP BY 1, 2""")
def ups_3_edges(spark, sf_dir):
    """Upsert of containment edges: edges of user turns exist, all turns are
    upserted; existing (parent, child) keys are kept, new ones inserted."""
    c = read(spark, sf_dir, "conversations")
    ff = c.select(content_sha256(F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))).alias("parent_sha256"),
                  content_sha256(F.col("text")).alias("child_sha256"), "role")
    cur = ff.filter(F.col("role") == "user").select("parent_sha256", "child_sha256").distinct() \
            .withColumn("origin", F.lit("existing"))
    new = ff.select("parent_sha256", "child_sha256").withColumn("origin", F.lit("inserted"))
    return ST.insert_if_absent(cur, new, ["parent_sha256", "child_sha256"])


@register("ups_5_mapping", """
WITH f AS (SELECT sha256(text) AS file_sha256, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),
g AS (SELECT * FROM f WHERE file_sha256 IN (SELECT sha256(text) FROM documents WHERE source = 'src3')),
""" + chunks_cte("f").strip() + ",\n" + chunks_cte("g", target=3000, name="gc").strip() + """
SELECT file_sha256, idx, chunk_sha256 FROM fc WHERE file_sha256 NOT IN (SELECT file_sha256 FROM g)
UNION ALL SELECT file_sha256, idx, chunk_sha256 FROM gc""")
def ups_5_mapping(spark, sf_dir):
    """File → chunk mapping replaced per file: files of source src3 are
    re-chunked (target 3000) and their whole chunk lists replaced; other
    files keep theirs."""
    d = read(spark, sf_dir, "documents")
    files = dedup_files(d)
    cur = file_chunks(files).select("file_sha256", F.col("idx").cast("bigint").alias("idx"), "chunk_sha256")
    src3 = d.filter(F.col("source") == "src3").select(content_sha256(F.col("text")).alias("sha256")).distinct()
    redo = files.join(src3, "sha256", "left_semi")
    new = file_chunks(redo, target=3000).select("file_sha256", F.col("idx").cast("bigint").alias("idx"), "chunk_sha256")
    return ST.replace_mapping(cur, new, "file_sha256")
