"""WARC archives: one gzip member per record, written and read back in Spark.

Writing: records are laid out by one map; each task streams its records into
an archive of its own under a fresh name and reports it, so a retried task
leaves an unnamed file and no wrong record.  Of records with equal payloads of
at least ``MIN_REVISIT`` bytes the one with the largest page_id is a response
and the others are revisits that carry the HTTP header only.

Reading is sequential: an archive is read in blocks, each gzip member is
decompressed incrementally, its header parsed, its block framed by
Content-Length, and both digests verified.  A broken record gives a row with an
``error`` and, as members are independent, reading goes on at the next one when
the stream allows it.

Defined cases: null html is an empty payload, a null url leaves the target out,
a null page_id is kept as null and its record is always a response; line breaks
in a url are percent-encoded; repeated rows are records of their own, equal to
each other; an empty table gives no archive and an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import prepare, staged

MIN_REVISIT = 1000
BLOCK = 1 << 16
#: An archive is closed and a new one begun past this many compressed bytes.
ARCHIVE_BYTES = 1 << 28
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
RECORD = "urn:page:"


def record_roles(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) → page_id, url, html, refers_to (null: response).
    Only keys are grouped: copies collapse map-side, and the join to the groups
    is salted, so one payload may hold any share of the rows."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = staged(pages.select("page_id", F.sha1(raw).alias("digest"), F.octet_length(raw).cast("long").alias("n"))
                  .where((F.col("n") >= MIN_REVISIT) & F.col("page_id").isNotNull()), "warc-keys")
    groups = (keys.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
              .where(F.col("least") < F.col("refers_to")).select("digest", "n", "refers_to")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    revisits = (keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(groups, ["digest", "n", "salt"])
                .where(F.col("page_id") < F.col("refers_to")).groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to")))
    sent = pages.select("page_id", "url", "html", F.sha1(raw).alias("digest"))
    return sent.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id, url, payload: bytes, refers_to) -> bytes:
    """One record before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}",
             f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _store(uri: str):
    """(filesystem, path) of a location in any store that pyarrow knows."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """records(page_id, url, html, refers_to) → manifest(path, bytes, records)
    of the archives written below ``folder``."""
    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, name, size, count = None, None, 0, 0
        done = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns, strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}")
                data = _member(record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "bytes", "records"])

    return staged(records.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


#: Start of a gzip member, of the record inside, and the bytes that must show it.
GZIP, OPENING, PROBE = b"\x1f\x8b\x08", b"WARC/", 4096


def members(stream, block: int = BLOCK) -> Iterator[tuple[bytes, str | None]]:
    """(record, error) of each gzip member of a binary stream, read in blocks.
    After a broken member reading goes on at the next one that opens a record,
    if there is one; the error then tells how many bytes were passed over."""
    z, parts, raw, pending = zlib.decompressobj(31), [], [], b""
    while True:
        data = pending or stream.read(block)
        pending, fault = b"", None
        if data:
            raw.append(data)
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                fault = f"bad member: {e}"
        elif raw:
            fault = "truncated member"
        else:
            return
        if fault is not None:
            skipped, pending = _resume(stream, b"".join(raw), block)
            yield b"".join(parts), f"{fault}; {skipped} bytes skipped" if pending else fault
        elif z.eof:
            yield b"".join(parts), None
            pending = z.unused_data
        else:
            continue
        z, parts, raw = zlib.decompressobj(31), [], []


def _resume(stream, data: bytes, block: int) -> tuple[int, bytes]:
    """(bytes passed over, bytes from the next member on): the first gzip header
    behind the start of ``data`` whose member opens a record, read on from the
    stream as far as needed."""
    gone, at = 0, 1
    while True:
        at = data.find(GZIP, at)
        short = at < 0
        if not short:
            try:
                opens = zlib.decompressobj(31).decompress(data[at:at + PROBE], len(OPENING))
                if opens == OPENING:
                    return gone + at, data[at:]
                short = len(opens) < len(OPENING) and OPENING.startswith(opens) and at + PROBE > len(data)
            except zlib.error:
                pass
            if not short:
                at += 1
                continue
        keep = at if at >= 0 else max(len(data) - len(GZIP) + 1, 0)
        more = stream.read(block)
        if not more:
            if at < 0:
                return gone + len(data), b""
            at += 1
            continue
        gone, data, at = gone + keep, data[keep:] + more, 0 if at >= 0 or keep else 1


def parse_record(data: bytes) -> dict:
    """Fields of one record: its headers, framed block and verified digests.
    ``error`` names the first thing that doesn't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return {"error": "no record header"}
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not length.isdigit():
        return {"error": "no content length"}
    block, tail = rest[:int(length)], rest[int(length):]
    if len(block) < int(length) or tail != b"\r\n\r\n":
        return {"error": "content length does not frame the record"}
    if fields.get("warc-block-digest") != _sha1(block):
        return {"error": "block digest differs"}
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    kind, claimed = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    if kind == "response" and (_sha1(payload) != claimed or str(len(payload)) != inner.get("content-length")):
        return {"error": "payload digest or length differs"}

    def page(value):
        value = (value or "").strip("<>").removeprefix(RECORD)
        return int(value) if value else None
    return {"page_id": page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": int(inner.get("content-length", 0)), "refers_to": page(fields.get("warc-refers-to")),
            "payload_digest": base64.b32decode(claimed.removeprefix("sha1:")).hex(),
            "payload": payload if kind == "response" else None, "error": None}


RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                           ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """manifest(path, …) → one row per record.  One task reads one archive from
    front to back; rows leave in batches of bounded bytes."""
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = _store(path)
                rows, held = [], 0
                with store.open_input_stream(name) as stream:
                    for data, broken in members(stream):
                        row = {"error": broken} if broken else parse_record(data)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row.get("payload") or b"") + 200
                        if held >= 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)

    files = max(manifest.count(), 1)
    return manifest.select("path").repartition(files).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string")


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as archives and read them back without payloads."""
    spark = pages.sparkSession
    prepare(spark)
    folder = scratch_path(spark, "warc")
    manifest = write_archives(record_roles(pages), folder, archive_bytes)
    return read_archives(spark, manifest, payloads=False)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(encode(h)) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM g
"""
