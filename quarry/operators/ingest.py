"""Composed ingest: requests → blobs → cache split → archive explode → routing →
conversion → finalize → files, sources, edges, blobs and chunks.

Archive members and inline images are files of the next generation; the loop
ends when a generation brings no unseen hash.  A generation reads only its own
new blobs, and every table of it is written to the shared checkpoint folder."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import sniff as S
from ..functions import text as T
from ..functions.media import image_profile, office_properties_of
from ..sources.archives import explode_archives
from .chunking import file_chunks
from .store import write_staged

EDGE_SCHEMA = "parent_sha256 string, child_sha256 string, meta map<string,string>"
FILE_SCHEMA = "sha256 string, route string, markdown string, meta map<string,string>, links array<string>, image_urls array<string>, generation int"
TABULAR = ("csv", "json", "ndjson")


def tabular_texts(rows: DataFrame) -> DataFrame:
    """rows(sha256, route, text) → sha256, t_markdown, t_meta for the texts that
    are tables; each text is one file, converted where it lies."""
    def run(batches):
        from ..functions.tables import table_markdown
        for batch in batches:
            for i in range(batch.num_rows):
                got = table_markdown(*(batch.column(c)[i].as_py() for c in ("route", "text", "dialect")))
                if got:
                    meta = [("num_rows", str(got["num_rows"])), ("num_cols", str(got["num_cols"])), ("columns", ", ".join(got["columns"]))]
                    yield pa.RecordBatch.from_arrays([batch.column("sha256").slice(i, 1), pa.array([got["markdown"]]),
                                                      pa.array([meta], pa.map_(pa.string(), pa.string()))], ["sha256", "t_markdown", "t_meta"])
    return rows.select("sha256", "route", "text", "dialect").mapInArrow(run, "sha256 string, t_markdown string, t_meta map<string,string>")


def convert_files(blobs: DataFrame) -> DataFrame:
    """blobs(sha256, content) → sha256, route, markdown, meta, links, image_urls,
    inline (bytes of the data-URI images).  Tables, HTML and text become
    markdown; binary routes keep null markdown and their content type."""
    routed = S.with_route(blobs.select("sha256", "content"), "content", "route", kind_out="kind", dialect_out="dialect")
    none = F.create_map().cast("map<string,string>")
    image = image_profile(F.when(F.col("route") == "image", F.col("content")))
    routed = routed.select("*", image.alias("image"), office_properties_of(F.when(F.col("kind").isin("docx", "xlsx", "pptx"), F.col("content"))).alias("office"))
    size = F.map_filter(F.create_map(F.lit("width"), F.col("image.width").cast("string"), F.lit("height"), F.col("image.height").cast("string")), lambda k, v: v.isNotNull())
    binary = F.map_concat(F.coalesce("image.exif", none), size, F.coalesce("office", none))
    routed = write_staged(routed.select("sha256", "route", "kind", "dialect", binary.alias("binary"), F.when(
        ~F.col("route").isin("archive", "image", "office", "pdf", "parquet"), T.normalize_text(F.col("content"))).alias("text")), "ingest-routed")
    tables = tabular_texts(routed.where(F.col("route").isin(*TABULAR)))
    rows = routed.join(tables, "sha256", "left")
    # a text that looked tabular but is no table goes on as text
    route = F.when(F.col("route").isin(*TABULAR) & F.col("t_markdown").isNull(),
                   F.when(S.html_doc_sniff(F.col("text")), "html").otherwise("markdown")).otherwise(F.col("route"))
    rows = rows.withColumn("route", route)
    page = F.col("route") == "html"
    # one search tells texts without an inline image, which are neither cut nor joined again
    holds = F.col("text").rlike(T.DATA_URI_RE)
    inline = F.transform(F.filter(T.whole_quads(T.data_uri_payloads(F.col("text"))), lambda p: p.isNotNull()), lambda p: F.unbase64(p))
    rows = rows.select("*", (F.col("route").isin("html", "markdown") & holds).alias("_holds"))
    rows = rows.select("*", F.when(F.col("_holds"), T.replace_data_uris(F.col("text"))).when(F.col("route").isin("html", "markdown"), F.col("text")).alias("body"),
                       F.when(F.col("_holds"), inline).when(F.col("route").isin("html", "markdown"), F.array().cast("array<binary>")).alias("inline"))
    rows = rows.select("*", H.html_to_markdown(F.col("body"), page).alias("_md"))
    rows = rows.select("*", T.resolve_markdown_refs(F.col("_md")).alias("plain"))
    rows = rows.select("*", T.linkify(F.coalesce("t_markdown", "plain")).alias("markdown"))
    kind = S.content_type(F.col("route"), F.col("kind"))
    meta = F.map_concat(F.when(kind.isNull(), none).otherwise(F.create_map(F.lit("content_type"), kind)), F.coalesce("t_meta", none), F.col("binary"),
                        F.when(page, H.html_metadata(F.col("text"))).otherwise(none))
    return rows.select("sha256", "route", "markdown", meta.alias("meta"), F.coalesce(T.extract_links(F.col("markdown")), F.array().cast("array<string>")).alias("links"),
                       F.coalesce(T.markdown_images(F.col("plain")), F.array().cast("array<string>")).alias("image_urls"), "inline")


@dataclass
class Collection:
    """The tables of a collection after an ingest."""
    files: DataFrame
    sources: DataFrame
    edges: DataFrame
    blobs: DataFrame
    chunks: DataFrame


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ingest(requests: DataFrame, known: DataFrame | None = None, max_generations: int | None = None) -> Collection:
    """requests(source, source_id, content) → the collection's new rows.

    ``known(sha256)`` are files already processed: they get their source rows but
    are not converted again.  Archive members enter with an edge of index
    ``parent`` and their path, inline images with one of index ``child``.  Archives
    and unknown files keep no blob.  A caller's bound that is reached with files
    left raises."""
    spark = requests.sparkSession
    asked = requests.select("source", "source_id", F.sha2("content", 256).alias("file_sha256"))
    waiting = requests.where(F.col("content").isNotNull()).select(F.sha2("content", 256).alias("sha256"), "content")
    files, edges, blobs, generation = [], [], [], 0
    seen = known.select("sha256") if known is not None else None
    while True:
        fresh = waiting.dropDuplicates(["sha256"])
        if seen is not None:
            fresh = fresh.join(seen, "sha256", "left_anti")
        fresh = write_staged(fresh, "ingest-fresh")
        if fresh.isEmpty():
            break
        if max_generations is not None and generation >= max_generations:
            raise RuntimeError(f"files are left after {max_generations} generations")
        converted = write_staged(convert_files(fresh), "ingest-converted")
        members = write_staged(explode_archives(fresh).select("parent_sha256", "path", F.col("child_sha256").alias("sha256"), "content"), "ingest-members")
        images = converted.select(F.col("sha256").alias("parent_sha256"), F.explode("inline").alias("content")).withColumn("sha256", F.sha2("content", 256))
        edges.append(members.select("parent_sha256", F.col("sha256").alias("child_sha256"),
                                    F.create_map(F.lit("index"), F.lit("parent"), F.lit("filename"), F.col("path")).alias("meta")))
        edges.append(images.select("parent_sha256", F.col("sha256").alias("child_sha256"), F.create_map(F.lit("index"), F.lit("child")).alias("meta")))
        files.append(converted.drop("inline").withColumn("generation", F.lit(generation)))
        keep = converted.where((F.col("route") != "archive")).select("sha256", F.col("meta")["content_type"].alias("content_type"))
        blobs.append(fresh.join(keep, "sha256").select("sha256", "content", "content_type", F.octet_length("content").cast("bigint").alias("length")))
        seen = fresh.select("sha256") if seen is None else seen.unionByName(fresh.select("sha256"))
        waiting = members.select("sha256", "content").unionByName(images.select("sha256", "content"))
        generation += 1
    if not files:
        empty = spark.createDataFrame([], FILE_SCHEMA)
        files, edges = [empty], [spark.createDataFrame([], EDGE_SCHEMA)]
        blobs = [spark.createDataFrame([], "sha256 string, content binary, content_type string, length bigint")]
    out = _union(files)
    chunks = file_chunks(out.where(F.col("markdown").isNotNull()), keep_empty=False)
    return Collection(out, asked, _union(edges), _union(blobs), chunks)
