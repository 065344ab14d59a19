"""Queries: URL freshness (lookup and as-of), cache check, containment edges,
readiness, orphan sweeps, referential checks, queues, counts and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_sha256
from ..operators import lifecycle as L
from ..operators.store import write_staged
from .registry import register
from .sql import chunks_cte, AS_OF_SQL, FILE_FILES_CTE, FILES_CTE, SOURCES_CTE, URL_FILES_CTE
from .tables import (AS_OF, EPOCH, epoch_seconds, file_files_table, read, sources_table, ts_ntz,
                     file_states, url_files_table)


def _url_requests(spark, sf_dir):
    """URL requests: every click/view event asks for the page numbered by its user."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    return (e.join(p, e["user_id"] == p["page_id"])
             .select("event_id", "url", "ts", F.lit(86400).alias("max_age")))


@register("join_1_freshness", f"""
WITH {URL_FILES_CTE.strip()},
r AS (SELECT e.event_id, p.url, e.ts FROM events e JOIN pages p ON e.user_id = p.page_id
      WHERE e.event_type IN ('click', 'view')),
j AS (SELECT r.event_id, r.url, u.file_sha256, (epoch_us(r.ts) - epoch_us(u.fetched_at)) // 1000000 AS age FROM r LEFT JOIN url_files u ON r.url = u.url)
SELECT event_id, url, coalesce(age >= 0 AND age <= 86400, false) AS hit,
       CASE WHEN age >= 0 AND age <= 86400 THEN file_sha256 END AS file_sha256
FROM j""")
def join_1_freshness(spark, sf_dir):
    """URL freshness lookup: request ⟕ url_files, hit when fetched within max_age
    before the request; misses form the refetch list."""
    r = _url_requests(spark, sf_dir)
    out = L.freshness_lookup(r, url_files_table(spark, sf_dir))
    return out.select("event_id", "url", "hit", "file_sha256")


@register("join_1_asof", """
WITH f AS (SELECT user_id AS page, ts, sha256('v' || event_id) AS sha FROM events WHERE event_type = 'view'),
r AS (SELECT event_id, user_id AS page, ts FROM events WHERE event_type = 'click'),
j AS (SELECT r.event_id, r.ts, f.sha, f.ts AS fts FROM r ASOF LEFT JOIN f ON r.page = f.page AND r.ts >= f.ts)
SELECT event_id, sha AS file_sha256, coalesce((epoch_us(ts) - epoch_us(fts)) // 1000000, -1) AS age_s,
       coalesce((epoch_us(ts) - epoch_us(fts)) // 1000000 <= 21600, false) AS fresh
FROM j""")
def join_1_asof(spark, sf_dir):
    """As-of freshness: each click gets the latest earlier view-fetch of its page;
    fresh when at most 6 hours old (skew-safe bucketed as-of join); age -1
    when the page was never fetched before."""
    e = read(spark, sf_dir, "events")
    f = e.filter(F.col("event_type") == "view").select(
        F.col("user_id").alias("page"), F.col("ts").alias("fts"),
        content_sha256(F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("sha"))
    r = e.filter(F.col("event_type") == "click").select("event_id", F.col("user_id").alias("page"), "ts")
    j = L.asof_latest(r, f, "page", "ts", "fts", ["sha"], bucket_seconds=6 * 3600)
    age = F.timestamp_diff("SECOND", F.col("asof_fts"), F.col("ts")).cast("bigint")
    return j.select("event_id", F.col("asof_sha").alias("file_sha256"), F.coalesce(age, F.lit(-1).cast("bigint")).alias("age_s"),
                    F.coalesce(age <= 21600, F.lit(False)).alias("fresh"))


@register("join_2_cache", f"""
WITH {FILES_CTE.strip()}
SELECT d.doc_id, CASE WHEN f.parsed_at IS NOT NULL THEN 'cached' ELSE 'new' END AS status
FROM documents d LEFT JOIN files f ON sha256(d.text) = f.sha256""")
def join_2_cache(spark, sf_dir):
    """Content cache check: incoming hashes already processed skip conversion."""
    d = read(spark, sf_dir, "documents").select("doc_id", content_sha256(F.col("text")).alias("sha256"))
    new, cached = L.split_cached(d, file_states(spark, sf_dir))
    return (new.select("doc_id", F.lit("new").alias("status"))
               .unionByName(cached.select("doc_id", F.lit("cached").alias("status"))))


@register("join_3_edges", f"""
WITH {FILE_FILES_CTE.strip()}
SELECT parent_sha256, child_sha256, 'parent' AS idx, 'turn_' || CAST(min(turn) AS VARCHAR) || '.txt' AS filename,
       count(*) AS n_refs
FROM file_files GROUP BY 1, 2""")
def join_3_edges(spark, sf_dir):
    """Containment edges (conversation → turn files), upserted on (parent, child)."""
    ff = file_files_table(spark, sf_dir)
    return (ff.groupBy("parent_sha256", "child_sha256")
              .agg(F.min("turn").alias("t"), F.count(F.lit(1)).alias("n_refs"))
              .select("parent_sha256", "child_sha256", F.lit("parent").alias("idx"),
                      F.concat(F.lit("turn_"), F.col("t").cast("string"), F.lit(".txt")).alias("filename"), "n_refs"))


CONV_FILES = """
cf AS (SELECT sha256('conv:' || CAST(conv_id AS VARCHAR)) AS sha256, TIMESTAMP '2024-01-01 00:00:00' AS parsed_at
       FROM conversations GROUP BY conv_id
       UNION SELECT sha256(text), CASE WHEN length(text) % 5 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' END
       FROM conversations)"""


def _conv_files(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    parents = c.select(content_sha256(F.concat(F.lit("conv:"), F.col("conv_id").cast("string"))).alias("sha256"),
                       ts_ntz(EPOCH).alias("parsed_at"))
    kids = c.select(content_sha256(F.col("text")).alias("sha256"),
                    F.when(F.length("text") % 5 != 0, ts_ntz(EPOCH)).alias("parsed_at"))
    return parents.unionByName(kids).distinct()


@register("join_4_readiness", f"""
WITH {FILE_FILES_CTE.strip()}, {CONV_FILES.strip()},
e AS (SELECT DISTINCT parent_sha256, child_sha256 FROM file_files),
k AS (SELECT e.parent_sha256, count(*) AS n_children, count(*) FILTER (WHERE c.parsed_at IS NOT NULL) AS n_children_parsed
      FROM e LEFT JOIN cf c ON e.child_sha256 = c.sha256 GROUP BY 1)
SELECT f.sha256, f.parsed_at IS NOT NULL AS parsed, coalesce(n_children, 0) AS n_children,
       coalesce(n_children_parsed, 0) AS n_children_parsed,
       f.parsed_at IS NOT NULL AND coalesce(n_children, 0) = coalesce(n_children_parsed, 0) AS ready
FROM cf f LEFT JOIN k ON f.sha256 = k.parent_sha256""")
def join_4_readiness(spark, sf_dir):
    """Readiness gate: a file is indexable when it and all its children are parsed."""
    ff = file_files_table(spark, sf_dir).select("parent_sha256", "child_sha256").distinct()
    return L.readiness(_conv_files(spark, sf_dir), ff).select(
        "sha256", "parsed", F.col("n_children").cast("bigint").alias("n_children"),
        F.col("n_children_parsed").cast("bigint").alias("n_children_parsed"), "ready")


ORPHAN_CTES = f"""
{FILE_FILES_CTE.strip()},
allf AS (SELECT sha256(text) AS sha256 FROM documents
         UNION SELECT parent_sha256 FROM file_files UNION SELECT child_sha256 FROM file_files),
src AS (SELECT sha256(text) AS sha256 FROM documents WHERE source NOT IN ('src0', 'src1'))"""


def _orphan_inputs(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    ff = file_files_table(spark, sf_dir).select("parent_sha256", "child_sha256")
    files = (d.select(content_sha256(F.col("text")).alias("sha256"))
              .unionByName(ff.select(F.col("parent_sha256").alias("sha256")))
              .unionByName(ff.select(F.col("child_sha256").alias("sha256"))).distinct())
    src = d.filter(~F.col("source").isin("src0", "src1")).select(content_sha256(F.col("text")).alias("file_sha256"))
    return files, src, ff


@register("join_7_orphan_sweep", f"""
WITH {ORPHAN_CTES.strip()}
SELECT sha256 FROM allf WHERE sha256 NOT IN (SELECT sha256 FROM src) AND sha256 NOT IN (SELECT child_sha256 FROM file_files)""")
def join_7_orphan_sweep(spark, sf_dir):
    """One orphan sweep after sources src0/src1 are removed: files with no source
    and no parent."""
    files, src, ff = _orphan_inputs(spark, sf_dir)
    return L.orphan_sweep(files, src, ff)


@register("join_7_orphan_fixpoint", f"""
WITH RECURSIVE {ORPHAN_CTES.strip()},
keep(sha256) AS (SELECT sha256 FROM src
  UNION SELECT e.child_sha256 FROM file_files e JOIN keep k ON e.parent_sha256 = k.sha256),
gen1 AS (SELECT sha256 FROM allf WHERE sha256 NOT IN (SELECT sha256 FROM src)
         AND sha256 NOT IN (SELECT child_sha256 FROM file_files))
SELECT a.sha256, CAST(CASE WHEN g.sha256 IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS generation
FROM allf a LEFT JOIN gen1 g ON a.sha256 = g.sha256
WHERE a.sha256 NOT IN (SELECT sha256 FROM keep)""")
def join_7_orphan_fixpoint(spark, sf_dir):
    """Orphan sweeps to a fixpoint: every deleted file with its generation
    (parents first, then members whose parents were all deleted)."""
    files, src, ff = _orphan_inputs(spark, sf_dir)
    return L.orphan_generations(files, src, ff).select("sha256", F.col("generation").cast("int"))


@register("join_13_refcheck", f"""
WITH {URL_FILES_CTE.strip()}, {FILE_FILES_CTE.strip()}, {SOURCES_CTE.strip()},
files AS (SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE source <> 'src3'),
mapped AS (SELECT DISTINCT sha256(text) AS f, sha256('chunk:' || text) AS c, min(doc_id) AS d FROM documents GROUP BY 1, 2),
v AS (SELECT 'sources.file_sha256' AS "constraint", file_sha256 AS k FROM sources
      UNION ALL SELECT 'url_files.file_sha256', file_sha256 FROM url_files
      UNION ALL SELECT 'file_files.parent_sha256', parent_sha256 FROM file_files
      UNION ALL SELECT 'file_files.child_sha256', child_sha256 FROM file_files
      UNION ALL SELECT 'file_chunks.file_sha256', f FROM mapped),
bad AS (SELECT * FROM v WHERE k NOT IN (SELECT sha256 FROM files)
        UNION ALL SELECT 'file_chunks.chunk_sha256', c FROM mapped WHERE d % 5 = 0)
SELECT "constraint", count(*) AS n_violations, count(DISTINCT k) AS n_keys FROM bad GROUP BY 1""")
def join_13_refcheck(spark, sf_dir):
    """Foreign-key check of all six keys (files of source src3 and the chunks of
    every fifth document missing on purpose; one chunk per file here)."""
    d = read(spark, sf_dir, "documents")
    files = d.filter(F.col("source") != "src3").select(content_sha256(F.col("text")).alias("sha256")).distinct()
    mapped = d.groupBy(content_sha256(F.col("text")).alias("file_sha256"),
                       content_sha256(F.concat(F.lit("chunk:"), F.col("text"))).alias("chunk_sha256")).agg(F.min("doc_id").alias("d"))
    chunks = mapped.filter("d % 5 <> 0").select(F.col("chunk_sha256").alias("sha256"))
    bad = L.referential_check(files, sources_table(spark, sf_dir), url_files_table(spark, sf_dir),
                              file_files_table(spark, sf_dir), mapped, chunks)
    return bad.groupBy("constraint").agg(F.count(F.lit(1)).alias("n_violations"),
                                         F.countDistinct("key").alias("n_keys"))


@register("join_7_orphan_chunks", "WITH f AS (SELECT sha256(text) AS file_sha256, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),\n"
          + chunks_cte("f").strip() + """,
alive AS (SELECT sha256(text) AS f FROM documents WHERE source <> 'src3')
SELECT DISTINCT chunk_sha256 AS sha256 FROM fc
WHERE chunk_sha256 NOT IN (SELECT chunk_sha256 FROM fc WHERE file_sha256 IN (SELECT f FROM alive))""")
def join_7_orphan_chunks(spark, sf_dir):
    """Chunk sweep after a file sweep: the files held by source src3 alone are
    deleted, their mappings go with them, then the chunks that no mapping holds."""
    from ..operators.chunking import dedup_files, file_chunks
    d = read(spark, sf_dir, "documents")
    mapping = write_staged(file_chunks(dedup_files(d)).select("file_sha256", "chunk_sha256").distinct(), "chunk-mapping")
    alive = d.filter(F.col("source") != "src3").select(content_sha256(F.col("text")).alias("sha256")).distinct()
    return L.orphan_chunks(mapping.select(F.col("chunk_sha256").alias("sha256")).distinct(), L.cascade_mappings(mapping, alive))


@register("flt_11_unindexed", f"""
WITH {FILES_CTE.strip()}
SELECT sha256, doc_id FROM files WHERE parsed_at IS NOT NULL AND indexed_at IS NULL""")
def flt_11_unindexed(spark, sf_dir):
    """Unindexed queue: parsed but not indexed files."""
    return L.unindexed(file_states(spark, sf_dir)).select("sha256", "doc_id")


def _chunk_queue(spark, sf_dir, fc=None):
    from ..operators.chunking import dedup_files, file_chunks
    fc = file_chunks(dedup_files(read(spark, sf_dir, "documents"))) if fc is None else fc
    files = dedup_files(read(spark, sf_dir, "documents")).select(F.col("sha256").alias("file_sha256"),
                                                                F.col("first_doc_id"))
    emb = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("first_doc_id"), "embedding")
    c = (fc.join(files, "file_sha256")
           .groupBy(F.col("chunk_sha256").alias("sha256"))
           .agg(F.min(F.col("first_doc_id") * 100 + F.col("idx")).alias("order_key"),
                F.min("first_doc_id").alias("first_doc_id")))
    c = c.join(emb, "first_doc_id", "left")
    return c.select("sha256", "first_doc_id",
                    F.timestamp_add("SECOND", F.col("order_key"), ts_ntz(EPOCH)).alias("created_at"), "embedding")


CHUNK_QUEUE_SQL = """
WITH f AS (SELECT sha256(text) AS file_sha256, arg_min(text, doc_id) AS text, min(doc_id) AS first_doc_id FROM documents GROUP BY 1),
{chunks},
c AS (SELECT fc.chunk_sha256 AS sha256, min(f.first_doc_id * 100 + fc.idx) AS order_key, min(f.first_doc_id) AS first_doc_id
      FROM fc JOIN f ON fc.file_sha256 = f.file_sha256 GROUP BY 1),
q AS (SELECT c.sha256, c.first_doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c.order_key) AS created_at, e.embedding
      FROM c LEFT JOIN embeddings e ON e.vec_id = c.first_doc_id)"""


def _chunk_queue_sql():
    from .sql import chunks_cte
    return CHUNK_QUEUE_SQL.format(chunks=chunks_cte("f").strip())


@register("flt_12_unembedded", _chunk_queue_sql() + """
SELECT sha256, first_doc_id FROM q WHERE embedding IS NULL ORDER BY created_at, sha256 LIMIT 100""")
def flt_12_unembedded(spark, sf_dir):
    """Unembedded queue: the next 100 chunks without a vector, oldest first."""
    return L.unembedded(_chunk_queue(spark, sf_dir), 100).select("sha256", "first_doc_id")


@register("flt_13_expiry", f"""
WITH {SOURCES_CTE.strip()}
SELECT source, source_id FROM sources WHERE date_diff('second', touched_at, {AS_OF_SQL}) > 30 * 86400""")
def flt_13_expiry(spark, sf_dir):
    """Usage expiry: sources untouched for more than 30 days as of the fixed clock."""
    s = sources_table(spark, sf_dir)
    return L.expired(s, "touched_at", ts_ntz(AS_OF), 30 * 86400).select("source", "source_id")


@register("meta_3_age", f"""
WITH {URL_FILES_CTE.strip()}
SELECT url, CAST(date_diff('second', fetched_at, {AS_OF_SQL}) AS BIGINT) AS age_s,
       date_diff('second', fetched_at, {AS_OF_SQL}) <= 86400 * 50 AS fresh,
       CAST(epoch(fetched_at) AS BIGINT) AS fetched_epoch
FROM url_files""")
def meta_3_age(spark, sf_dir):
    """Freshness age of cached URLs as of the fixed clock (50-day max age)."""
    u = url_files_table(spark, sf_dir)
    age = L.age_seconds(F.col("fetched_at"), ts_ntz(AS_OF)).cast("bigint")
    return u.select("url", age.alias("age_s"), (age <= 86400 * 50).alias("fresh"),
                    epoch_seconds(F.col("fetched_at")).alias("fetched_epoch"))


@register("agg_10_refcounts", f"""
WITH {SOURCES_CTE.strip()}, {FILE_FILES_CTE.strip()},
a AS (SELECT file_sha256 AS sha256, count(*) AS n FROM sources GROUP BY 1),
b AS (SELECT child_sha256 AS sha256, count(DISTINCT parent_sha256) AS n FROM file_files GROUP BY 1)
SELECT coalesce(a.sha256, b.sha256) AS sha256, coalesce(a.n, 0) AS n_sources, coalesce(b.n, 0) AS n_parents
FROM a FULL JOIN b ON a.sha256 = b.sha256""")
def agg_10_refcounts(spark, sf_dir):
    """Reference counts per file: sources holding it and parents containing it."""
    a = sources_table(spark, sf_dir).groupBy(F.col("file_sha256").alias("sha256")).agg(F.count(F.lit(1)).alias("a"))
    b = (file_files_table(spark, sf_dir).groupBy(F.col("child_sha256").alias("sha256"))
         .agg(F.countDistinct("parent_sha256").alias("b")))
    j = a.join(b, "sha256", "full")
    return j.select("sha256", F.coalesce("a", F.lit(0)).alias("n_sources"), F.coalesce("b", F.lit(0)).alias("n_parents"))


@register("agg_11_status", f"""
WITH {FILES_CTE.strip()}
SELECT count(*) AS n_files,
  count(*) FILTER (WHERE parsed_at IS NULL) AS n_created,
  count(*) FILTER (WHERE parsed_at IS NOT NULL AND indexed_at IS NULL) AS n_parsed,
  count(*) FILTER (WHERE indexed_at IS NOT NULL) AS n_indexed,
  CAST(max(CASE WHEN parsed_at IS NOT NULL AND indexed_at IS NULL THEN date_diff('second', parsed_at, {AS_OF_SQL}) END) AS BIGINT) AS max_backlog_age_s
FROM files""")
def agg_11_status(spark, sf_dir):
    """Pipeline status: files per lifecycle state and the oldest backlog age."""
    f = file_states(spark, sf_dir)
    backlog = F.col("parsed_at").isNotNull() & F.col("indexed_at").isNull()
    return f.agg(F.count(F.lit(1)).alias("n_files"),
                 F.count_if(F.col("parsed_at").isNull()).alias("n_created"),
                 F.count_if(backlog).alias("n_parsed"),
                 F.count_if(F.col("indexed_at").isNotNull()).alias("n_indexed"),
                 F.max(F.when(backlog, L.age_seconds(F.col("parsed_at"), ts_ntz(AS_OF)))).cast("bigint")
                 .alias("max_backlog_age_s"))


@register("agg_12_savings", "WITH f AS (SELECT sha256(text) AS file_sha256, arg_min(text, doc_id) AS text FROM documents GROUP BY 1),\n"
          + chunks_cte("f").strip() + """,
d AS (SELECT source, sha256(text) AS sha, octet_length(encode(text)) AS nb FROM documents),
u AS (SELECT source, sha, any_value(nb) AS nb FROM d GROUP BY 1, 2),
c AS (SELECT d.source, count(*) AS n_chunks, count(DISTINCT fc.chunk_sha256) AS n_unique_chunks FROM d JOIN fc ON fc.file_sha256 = d.sha GROUP BY 1)
SELECT d.source, count(*) AS n_files, any_value(u.n_unique) AS n_unique,
       CAST(sum(nb) AS BIGINT) AS raw_bytes, CAST(any_value(u.unique_bytes) AS BIGINT) AS unique_bytes,
       any_value(c.n_chunks) AS n_chunks, any_value(c.n_unique_chunks) AS n_unique_chunks
FROM d JOIN (SELECT source, count(*) AS n_unique, sum(nb) AS unique_bytes FROM u GROUP BY 1) u ON d.source = u.source
JOIN c ON c.source = d.source GROUP BY 1""")
def agg_12_savings(spark, sf_dir):
    """Dedup savings per source: raw vs unique files, bytes and chunks.  A file's
    chunks are split once and weighed by its copies in the source."""
    from ..operators.chunking import dedup_files, file_chunks
    docs = read(spark, sf_dir, "documents")
    d = docs.select("source", content_sha256(F.col("text")).alias("sha"), F.octet_length(F.encode("text", "UTF-8")).alias("nb"))
    per = write_staged(d.groupBy("source", "sha").agg(F.count(F.lit(1)).alias("c"), F.any_value("nb").alias("nb")), "source-files")
    files = per.groupBy("source").agg(
        F.sum("c").cast("bigint").alias("n_files"), F.count(F.lit(1)).alias("n_unique"),
        F.sum(F.col("nb") * F.col("c")).cast("bigint").alias("raw_bytes"),
        F.sum("nb").cast("bigint").alias("unique_bytes"))
    fc = file_chunks(dedup_files(docs)).select(F.col("file_sha256").alias("sha"), "chunk_sha256").groupBy("sha", "chunk_sha256").agg(F.count(F.lit(1)).alias("k"))
    chunks = (per.select("source", "sha", "c").join(fc, "sha").groupBy("source", "chunk_sha256").agg(F.sum(F.col("c") * F.col("k")).alias("n"))
              .groupBy("source").agg(F.sum("n").cast("bigint").alias("n_chunks"), F.count(F.lit(1)).alias("n_unique_chunks")))
    return files.join(chunks, "source")


def _org_edges(spark, sf_dir):
    """Containment graph from the driver tables: region files contain nation
    files, nation files contain customer files."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    h = lambda p, col: content_sha256(F.concat(F.lit(p), F.col(col).cast("string")))
    e1 = n.select(h("region:", "n_regionkey").alias("parent_sha256"), h("nation:", "n_nationkey").alias("child_sha256"))
    e2 = c.select(h("nation:", "c_nationkey").alias("parent_sha256"), h("cust:", "c_custkey").alias("child_sha256"))
    return e1.unionByName(e2)


@register("join_5_ancestors", """
WITH RECURSIVE e AS (
  SELECT DISTINCT sha256('nation:' || n_nationkey) AS sha256, sha256('region:' || n_regionkey) AS up FROM nation
  UNION SELECT sha256('cust:' || c_custkey), sha256('nation:' || c_nationkey) FROM customer),
a(sha256, ancestor, depth) AS (SELECT sha256, up, 1 FROM e
  UNION ALL SELECT a.sha256, e.up, a.depth + 1 FROM a JOIN e ON a.ancestor = e.sha256 WHERE a.depth < 64)
SELECT sha256, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM a GROUP BY 1, 2""")
def join_5_ancestors(spark, sf_dir):
    """Transitive lineage: every file with each file containing it, directly
    or through intermediate containers, at the shortest depth."""
    return L.ancestors(_org_edges(spark, sf_dir)).select("sha256", "ancestor", F.col("depth").cast("int"))
