"""Properties of binary files read from their headers: size and EXIF scalars of
images, document properties of office files.  Bytes pass as Arrow batches; a
malformed file gives what was read before the fault, its MIME type at least."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column

# Names of the TIFF / EXIF tags of a file's first directory.
TAGS = {
    0x00FE: "NewSubfileType", 0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression",
    0x0106: "PhotometricInterpretation", 0x010A: "FillOrder", 0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make",
    0x0110: "Model", 0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip",
    0x0117: "StripByteCounts", 0x011C: "PlanarConfiguration", 0x011D: "PageName", 0x0128: "ResolutionUnit", 0x0131: "Software",
    0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer", 0x013D: "Predictor", 0x0153: "SampleFormat",
    0x0213: "YCbCrPositioning", 0x4746: "Rating", 0x8298: "Copyright", 0x8769: "ExifOffset", 0x8825: "GPSInfo",
}
#: Field types: code → (bytes, struct format); text is type 2.
TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
PROFILE = "struct<mime:string,width:bigint,height:bigint,exif:map<string,string>>"
# Start-of-frame markers of JPEG, and markers without a length.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
BARE = {0x01, *range(0xD0, 0xD9)}
#: Largest office property part that is read, in bytes.
PART_BYTES = 1 << 20
# OOXML property elements and the meta keys they fill.
CORE_PROPS = [("title", "title"), ("creator", "author"), ("subject", "subject"), ("description", "description"),
              ("keywords", "keywords"), ("category", "category"), ("lastModifiedBy", "last_modified_by"),
              ("created", "created"), ("modified", "modified")]
APP_PROPS = [("Application", "application"), ("Company", "company")]


def tiff_scalars(data: bytes) -> dict[str, str | int | float]:
    """Single texts and numbers of a TIFF structure's first directory."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    out = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(data):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
        if tag not in TAGS:
            continue
        if kind == 2:
            start = entry + 8 if n <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            out[TAGS[tag]] = data[start:start + n].split(b"\0")[0].decode("latin-1").strip()
        elif n == 1 and kind in TYPES:
            size, form = TYPES[kind]
            start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            out[TAGS[tag]] = struct.unpack_from(order + form, data, start)[0]
    return out


def _jpeg(data: bytes, found: dict) -> None:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in BARE:
            at += 2
            continue
        if marker in (0xD9, 0xDA):
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        if marker in FRAMES:
            found["height"], found["width"] = struct.unpack_from(">HH", data, at + 5)
        elif marker == 0xE1 and data[at + 4:at + 10] == b"Exif\0\0" and "exif" not in found:
            _exif(data[at + 10:at + 2 + size], found)
        at += 2 + size


def _exif(data: bytes, found: dict) -> None:
    try:
        found["exif"] = tiff_scalars(data)
    except (KeyError, struct.error):
        found["exif"] = {}


def _png(data: bytes, found: dict) -> None:
    found["width"], found["height"] = struct.unpack_from(">II", data, 16)
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"eXIf":
            _exif(data[at + 8:at + 8 + size], found)
        if kind == b"IEND":
            return
        at += 12 + size


def _webp(data: bytes, found: dict) -> None:
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        body = at + 8
        if kind == b"VP8X":
            found["width"] = 1 + int.from_bytes(data[body + 4:body + 7], "little")
            found["height"] = 1 + int.from_bytes(data[body + 7:body + 10], "little")
        elif kind == b"VP8 " and "width" not in found and data[body + 3:body + 6] == b"\x9d\x01\x2a":
            found["width"], found["height"] = (v & 0x3FFF for v in struct.unpack_from("<HH", data, body + 6))
        elif kind == b"VP8L" and "width" not in found and data[body:body + 1] == b"\x2f":
            bits = struct.unpack_from("<I", data, body + 1)[0]
            found["width"], found["height"] = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        elif kind == b"EXIF":
            _exif(data[body:body + size].removeprefix(b"Exif\0\0"), found)
        at = body + size + size % 2


def _gif(data: bytes, found: dict) -> None:
    found["width"], found["height"] = struct.unpack_from("<HH", data, 6)


def _bmp(data: bytes, found: dict) -> None:
    width, height = struct.unpack_from("<ii", data, 18)
    found["width"], found["height"] = width, abs(height)


def _tiff(data: bytes, found: dict) -> None:
    _exif(data, found)
    found["width"], found["height"] = (found["exif"].get(t) for t in ("ImageWidth", "ImageLength"))


KINDS = [(b"\x89PNG\r\n\x1a\n", "image/png", _png), (b"\xff\xd8\xff", "image/jpeg", _jpeg), (b"GIF8", "image/gif", _gif), (b"BM", "image/bmp", _bmp),
         (b"II*\0", "image/tiff", _tiff), (b"MM\0*", "image/tiff", _tiff)]


def profile(data: bytes | None) -> dict | None:
    """MIME type, size and EXIF scalars of an image; None for other bytes."""
    data = bytes(data or b"")
    mime, read = next(((m, f) for magic, m, f in KINDS if data.startswith(magic)), (None, None))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        mime, read = "image/webp", _webp
    if mime is None:
        return None
    found = {}
    try:
        read(data, found)
    except (struct.error, IndexError):
        pass
    exif = {k: str(v) for k, v in found.get("exif", {}).items()}
    return {"mime": mime, "width": found.get("width"), "height": found.get("height"), "exif": exif}


def properties(data: bytes | None) -> dict[str, str]:
    """Core and application properties of an OOXML file, blanks left out."""
    out = {}
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(data or b""))) as box:
            for path, props in (("docProps/core.xml", CORE_PROPS), ("docProps/app.xml", APP_PROPS)):
                if path not in box.namelist() or box.getinfo(path).file_size > PART_BYTES:
                    continue
                try:
                    root = ElementTree.fromstring(box.read(path))
                except ElementTree.ParseError:
                    continue
                texts = {}
                for element in root:
                    texts.setdefault(element.tag.rsplit("}", 1)[-1], (element.text or "").strip())
                out.update({key: texts[name] for name, key in props if texts.get(name)})
    except (zipfile.BadZipFile, KeyError, OSError, RuntimeError, NotImplementedError, ValueError):
        pass
    return out


def image_profile(content: Column) -> Column:
    """struct(mime, width, height, exif) of PNG, JPEG, GIF, BMP, TIFF and WebP
    bytes; null fields for other bytes."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(blobs):
        rows = [profile(b) or {"mime": None, "width": None, "height": None, "exif": None} for b in blobs]
        return pd.DataFrame({"mime": [r["mime"] for r in rows], "width": pd.array([r["width"] for r in rows], dtype="Int64"),
                             "height": pd.array([r["height"] for r in rows], dtype="Int64"), "exif": [r["exif"] for r in rows]})
    return pandas_udf(run, PROFILE)(content)


def office_properties_of(content: Column) -> Column:
    """Map of the document properties inside OOXML bytes."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(blobs):
        return pd.Series([properties(b) for b in blobs], dtype=object)
    return pandas_udf(run, "map<string,string>")(content)
