"""Image headers and office properties on bytes built by hand."""

import struct
import zlib

from pyspark.sql import functions as F

from quarry.functions.media import image_profile, profile, properties
from quarry.operators.ingest import convert_files
from quarry.sources.archives import pack


def tiff(order, fields, extra=b""):
    """A TIFF structure: fields are (tag, type, count, 4 value bytes)."""
    head = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8)
    return head + struct.pack(order + "H", len(fields)) + b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in fields) + b"\0" * 4 + extra


def exif(order="<"):
    at = 8 + 2 + 3 * 12 + 4
    return tiff(order, [(0x010F, 2, 6, struct.pack(order + "I", at)), (0x0112, 3, 1, struct.pack(order + "HH", 6, 0)), (0x011A, 5, 1, struct.pack(order + "I", at))], b"Maker\0" + b"\0" * 8)


def jpeg(frame=0xC0, with_exif=True):
    def part(marker, body):
        return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    app1 = part(0xE1, b"Exif\0\0" + exif(">")) if with_exif else b""
    return b"\xff\xd8" + part(0xE0, b"JFIF\0" + b"\0" * 9) + app1 + b"\xff" + part(0xDB, b"\xff" * 65) + part(frame, struct.pack(">BHHB", 8, 480, 640, 3) + b"\0" * 9) + b"\xff\xda\0\x02xx\xff\xd9"


def png():
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 31, 17, 8, 6, 0, 0, 0)) + chunk(b"eXIf", exif()) + chunk(b"IEND", b"")


def webp(kind, body, more=b""):
    chunk = kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk) + len(more)) + b"WEBP" + chunk + more


VP8X = b"\0" * 4 + (1023).to_bytes(3, "little") + (767).to_bytes(3, "little")
IMAGES = {
    "jpeg": (jpeg(), ("image/jpeg", 640, 480, {"Make": "Maker", "Orientation": "6"})),
    "progressive": (jpeg(0xC2, False), ("image/jpeg", 640, 480, {})),
    "png": (png(), ("image/png", 31, 17, {"Make": "Maker", "Orientation": "6"})),
    "gif": (b"GIF89a" + struct.pack("<HH", 300, 2) + b"\0" * 3, ("image/gif", 300, 2, {})),
    "bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -7), ("image/bmp", 5, 7, {})),
    "tiff": (tiff(">", [(0x0100, 3, 1, struct.pack(">HH", 70, 0)), (0x0101, 4, 1, struct.pack(">I", 90000))]), ("image/tiff", 70, 90000, {"ImageWidth": "70", "ImageLength": "90000"})),
    "vp8": (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 176, 144 | 0x4000)), ("image/webp", 176, 144, {})),
    "vp8l": (webp(b"VP8L", b"\x2f" + struct.pack("<I", (99) | (49 << 14))), ("image/webp", 100, 50, {})),
    "vp8x": (webp(b"VP8X", VP8X, b"EXIF" + struct.pack("<I", len(exif())) + exif()), ("image/webp", 1024, 768, {"Make": "Maker", "Orientation": "6"})),
    "cut jpeg": (jpeg()[:30], ("image/jpeg", None, None, {})),
    "cut png": (b"\x89PNG\r\n\x1a\n\0\0", ("image/png", None, None, {})),
    "broken exif": (jpeg().replace(b"MM\0*", b"XX\0*"), ("image/jpeg", 640, 480, {})),
}


def test_headers_by_hand(spark):
    for name, (data, want) in IMAGES.items():
        got = profile(data)
        assert (got["mime"], got["width"], got["height"], got["exif"]) == want, name
    assert profile(b"text") is None and profile(None) is None
    rows = [(n, bytearray(d)) for n, (d, _) in IMAGES.items()] + [("none", None), ("text", bytearray(b"hello"))]
    df = spark.createDataFrame(rows, "n string, content binary").select("n", image_profile(F.col("content")).alias("p")).select("n", "p.*")
    got = {r.n: (r.mime, r.width, r.height, r.exif) for r in df.collect()}
    assert {n: got[n] for n in IMAGES} == {n: w for n, (_, w) in IMAGES.items()} and got["none"] == got["text"] == (None, None, None, None)


CORE = b'<cp:coreProperties xmlns:cp="urn:cp" xmlns:dc="urn:dc"><dc:title> T </dc:title><dc:creator>A</dc:creator><dc:subject> </dc:subject></cp:coreProperties>'


def test_office_properties_by_hand():
    whole = pack([("word/document.xml", b"<w/>"), ("docProps/core.xml", CORE), ("docProps/app.xml", b"<Properties><Application>W</Application></Properties>")], "zip")
    assert properties(whole) == {"title": "T", "author": "A", "application": "W"}
    assert properties(pack([("docProps/core.xml", b"<broken"), ("docProps/app.xml", b"<P><Company>C</Company></P>")], "zip")) == {"company": "C"}
    assert properties(b"PK\x03\x04broken") == properties(None) == {}


def test_file_meta_holds_the_properties(spark):
    docx = pack([("[Content_Types].xml", b"<T/>"), ("word/document.xml", b"<w/>"), ("docProps/core.xml", CORE)], "zip")
    rows = [("i", bytearray(jpeg())), ("o", bytearray(docx)), ("t", bytearray(b"plain"))]
    got = {r.sha256: r.meta for r in convert_files(spark.createDataFrame(rows, "sha256 string, content binary")).collect()}
    assert got["i"] == {"content_type": "image/jpeg", "width": "640", "height": "480", "Make": "Maker", "Orientation": "6"}
    assert got["o"]["title"] == "T" and got["o"]["author"] == "A" and got["o"]["content_type"].endswith("wordprocessingml.document")
    assert got["t"] == {"content_type": "text/markdown"}
