"""Queries: archive explode (zip, tar.gz, nested), member counts, path
sanitizing and the greedy extraction budget."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.store import write_staged
from ..sources import archives as A
from .registry import register
from .tables import read

BUCKET = 25          # documents per archive in the fixture
ARCHIVE_SCHEMA = pa.schema([("source", pa.string()), ("bucket", pa.int64()), ("kind", pa.string()), ("content", pa.binary())])


def _pack_group(src: str, docs: list[tuple[int, str]]) -> tuple[str, bytes]:
    """(kind, archive) of the documents of one source and bucket, in order of ids."""
    n = int(src[3:]) if src[3:].isdigit() else 0
    members = [(f"src/{src}/{d}.txt", t.encode("utf-8")) for d, t in docs]
    if n % 3 == 0:
        first, text = docs[0]
        extra = [("dir/", b""), (f"/abs/{first}.txt", text.encode("utf-8")), ("../evil.txt", b"x"), ("a/../../up.txt", b"y")]
        return "zip", A.pack(members + extra, "zip")
    if n % 3 == 1:
        return "tar.gz", A.pack(members, "tar.gz")
    return "zip>tar", A.pack([("inner.tar", A.pack(members, "tar"))], "zip")


def _pack_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, bucket, doc_id, text) sorted by the first three → one archive
    per source and bucket; a group may go over several batches, and only one is held."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
    done, held = [], 0
    for (src, bucket), group in groupby(rows, lambda row: row[:2]):
        kind, data = _pack_group(src, [row[2:] for row in group])
        done.append({"source": src, "bucket": int(bucket), "kind": kind, "content": data})
        held += len(data) + 256
        if held >= A.BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(done, ARCHIVE_SCHEMA)
            done, held = [], 0
    if done:
        yield pa.RecordBatch.from_pylist(done, ARCHIVE_SCHEMA)


def archives_df(spark, sf_dir, docs=None):
    """Documents packed into archives per (source, bucket of 25 doc ids):
    zips with unsafe / absolute / directory entries, tar.gz files, and zips
    holding a nested tar.  A task reads its groups in one sorted stream: most
    hold one or two documents, so work per group must be small."""
    docs = read(spark, sf_dir, "documents") if docs is None else docs
    d = docs.select("source", F.floor(F.col("doc_id") / BUCKET).cast("bigint").alias("bucket"), "doc_id", "text")
    return (d.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "doc_id")
            .mapInArrow(_pack_sorted, "source string, bucket bigint, kind string, content binary"))


MEMBERS_SQL = """
WITH d AS (SELECT doc_id, text, source, CAST(floor(doc_id / 25) AS BIGINT) AS bucket,
                  CAST(substr(source, 4) AS INTEGER) % 3 AS k FROM documents),
m AS (SELECT source, bucket, CASE WHEN k = 2 THEN 'inner.tar/' ELSE '' END || 'src/' || source || '/' || doc_id || '.txt' AS path,
             sha256(text) AS child_sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM d
      UNION ALL
      SELECT source, bucket, 'abs/' || arg_min(doc_id, doc_id) || '.txt', sha256(arg_min(text, doc_id)),
             CAST(octet_length(encode(arg_min(text, doc_id))) AS BIGINT) FROM d WHERE k = 0 GROUP BY 1, 2)"""


@register("src_10_explode", MEMBERS_SQL + """
SELECT source, bucket, path, child_sha256, size FROM m""")
def src_10_explode(spark, sf_dir):
    """Archive explode: every member of zip, tar.gz and zip-in-zip archives,
    directories and unsafe names skipped, absolute names made relative,
    nested members prefixed by the inner archive's path."""
    arc = write_staged(archives_df(spark, sf_dir), "archives")
    keys = arc.select(F.sha2("content", 256).alias("parent_sha256"), "source", "bucket")
    mem = A.explode_archives(arc.select("content"))
    return mem.join(keys, "parent_sha256").select("source", "bucket", "path", "child_sha256", "size")


@register("agg_6_num_files", MEMBERS_SQL + """
SELECT source, bucket, count(*) AS num_files, CAST(sum(size) AS BIGINT) AS total_bytes FROM m GROUP BY 1, 2""")
def agg_6_num_files(spark, sf_dir):
    """Archive profile: members after recursion and their bytes per archive."""
    arc = write_staged(archives_df(spark, sf_dir), "archives")
    keys = arc.select(F.sha2("content", 256).alias("parent_sha256"), "source", "bucket")
    mem = A.explode_archives(arc.select("content"))
    return (mem.groupBy("parent_sha256").agg(F.count(F.lit(1)).alias("num_files"),
                                             F.sum("size").cast("bigint").alias("total_bytes"))
               .join(keys, "parent_sha256").select("source", "bucket", "num_files", "total_bytes"))


def _raw_paths():
    did = F.col("doc_id").cast("string")
    return [F.concat("source", F.lit("/./"), "lang", F.lit("/../"), did, F.lit(".txt")),
            F.concat(F.lit("/"), "source", F.lit("//"), did),
            F.concat(F.lit("../"), "source"),
            F.concat("source", F.lit("/../../"), did),
            F.concat(F.lit(".."), "lang"),
            F.concat(F.lit("/../"), "lang", F.lit("/./"), did, F.lit("/")),
            F.concat(F.lit("./"), "lang", F.lit("/..")),
            F.concat("lang", F.lit("/x/../../.."), F.lit("/"), did)]


PATHS_SQL = ["source || '/./' || lang || '/../' || doc_id || '.txt'", "'/' || source || '//' || doc_id",
             "'../' || source", "source || '/../../' || doc_id", "'..' || lang",
             "'/../' || lang || '/./' || doc_id || '/'", "'./' || lang || '/..'",
             "lang || '/x/../../..' || '/' || doc_id"]

FOLD_SQL = """list_reduce(string_split(p, '/'), lambda acc, s:
   CASE WHEN s = '' OR s = '.' THEN acc
        WHEN s = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[1:len(acc) - 1]
        WHEN s = '..' AND starts_with(p, '/') THEN acc
        ELSE list_append(acc, s) END, []::VARCHAR[])"""


@register("flt_8_sanitize", "WITH r AS (" + " UNION ALL ".join(
    f"SELECT doc_id * 10 + {i} AS id, {e} AS p FROM documents" for i, e in enumerate(PATHS_SQL)) + f"""),
f AS (SELECT id, p, array_to_string({FOLD_SQL}, '/') AS j FROM r),
c AS (SELECT id, CASE WHEN j = '' THEN CASE WHEN starts_with(p, '/') THEN '' ELSE '.' END ELSE j END AS c FROM f)
SELECT id, CASE WHEN NOT starts_with(c, '..') THEN c END AS clean FROM c""")
def flt_8_sanitize(spark, sf_dir):
    """Member path sanitizing (normpath, strip leading '/', reject paths that
    climb out) over paths built from document fields."""
    d = read(spark, sf_dir, "documents")
    parts = [d.select((F.col("doc_id") * 10 + i).alias("id"), e.alias("p")) for i, e in enumerate(_raw_paths())]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.select("id", A.sanitize_path(F.col("p")).alias("clean"))


@register("win_7_budget", """
WITH l AS (SELECT source || '/' || CAST(floor(doc_id / 25) AS BIGINT) AS archive,
                  list({'p': doc_id, 's': n_chars} ORDER BY doc_id) AS l FROM documents GROUP BY 1),
f AS (SELECT archive, list_reduce(l, lambda acc, m: {'rem': CASE WHEN m.s <= 5000 AND m.s <= acc.rem THEN acc.rem - m.s ELSE acc.rem END,
        'out': list_append(acc.out, {'p': m.p, 'k': m.s <= 5000 AND m.s <= acc.rem})},
        {'rem': 8000::BIGINT, 'out': []::STRUCT(p BIGINT, k BOOLEAN)[]}).out AS o FROM l)
SELECT archive, CAST(x.p AS BIGINT) AS doc_id, x.k AS kept FROM (SELECT archive, unnest(o) AS x FROM f)""")
def win_7_budget(spark, sf_dir):
    """Greedy extraction budget per archive listing (the fixture's archives:
    documents of a source in blocks of 25 ids; cap 5000, budget 8000):
    first-fit, so a skipped member does not stop smaller later ones."""
    d = read(spark, sf_dir, "documents").withColumn(
        "archive", F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / BUCKET).cast("bigint").cast("string")))
    r = A.budget_select(d, "archive", "doc_id", "n_chars", 5000, 8000)
    return r.select("archive", F.col("doc_id").cast("bigint").alias("doc_id"), "kept")


@register("src_11_limits", """
WITH d AS (SELECT doc_id, text, source, CAST(floor(doc_id / 25) AS BIGINT) AS bucket,
                  CAST(substr(source, 4) AS INTEGER) % 3 AS k FROM documents),
m AS (SELECT source, bucket, doc_id AS pos, 'src/' || source || '/' || doc_id || '.txt' AS path,
             CAST(octet_length(encode(text)) AS BIGINT) AS size FROM d WHERE k = 0
      UNION ALL
      SELECT source, bucket, 1000000000, 'abs/' || arg_min(doc_id, doc_id) || '.txt',
             CAST(octet_length(encode(arg_min(text, doc_id))) AS BIGINT) FROM d WHERE k = 0 GROUP BY 1, 2),
l AS (SELECT source, bucket, list({'path': path, 's': size} ORDER BY pos) AS l FROM m GROUP BY 1, 2),
f AS (SELECT source, bucket, list_reduce(l, lambda acc, x: {'rem': CASE WHEN x.s <= least(3000, acc.rem) THEN acc.rem - x.s ELSE acc.rem END,
        'out': CASE WHEN x.s <= least(3000, acc.rem) THEN list_append(acc.out, {'path': x.path, 's': x.s}) ELSE acc.out END},
        {'rem': 20000::BIGINT, 'out': []::STRUCT(path VARCHAR, s BIGINT)[]}).out AS o FROM l)
SELECT source, bucket, y.path AS path, y.s AS size FROM (SELECT source, bucket, unnest(o) AS y FROM f)""")
def src_11_limits(spark, sf_dir):
    """Archive limits: members over min(file cap, remaining budget) are skipped
    without charge (cap 3000 bytes, budget 20000 here); a gz whose content is
    over the cap yields nothing; a nested archive over the cap is skipped."""
    arc = write_staged(archives_df(spark, sf_dir), "archives")
    keys = arc.select(F.sha2("content", 256).alias("parent_sha256"), "source", "bucket")
    mem = A.explode_archives(arc.select("content"), max_file=3000, max_total=20000)
    return mem.join(keys, "parent_sha256").select("source", "bucket", "path", "size")
