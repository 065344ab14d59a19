"""File-type sniffing and format routing as Column expressions over bytes.

Only the leading bytes of a blob are inspected (``substring`` before any
comparison), so the scan never materialises large contents for routing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, bind, normalize_text

# Magic numbers (hex) of the formats the router distinguishes.
MAGIC = [
    ("gz", 0, "1F8B"),
    ("zip", 0, "504B0304"),
    ("pdf", 0, "25504446"),                 # %PDF
    ("png", 0, "89504E470D0A1A0A"),
    ("jpg", 0, "FFD8FF"),
    ("gif", 0, "47494638"),                 # GIF8
    ("bmp", 0, "424D"),                     # BM
    ("tif", 0, "49492A00"),
    ("tif", 0, "4D4D002A"),
    ("ole", 0, "D0CF11E0A1B11AE1"),         # doc / xls / ppt container
    ("parquet", 0, "50415231"),             # PAR1
]
IMAGE_MIME = {"png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp",
              "tif": "image/tiff", "webp": "image/webp"}
OFFICE_ZIP_MARKERS = [("docx", "word/"), ("xlsx", "xl/"), ("pptx", "ppt/")]
ODF_MIMES = [("odp", "application/vnd.oasis.opendocument.presentation"),
             ("ods", "application/vnd.oasis.opendocument.spreadsheet"),
             ("odt", "application/vnd.oasis.opendocument.text")]
CSV_DELIMS = [",", ";", "\t", "|"]
#: Lines, and the share of them with the first line's fields, that make a text CSV.
CSV_MIN_ROWS = 5
CSV_SHARE = 0.9
#: Longest single value that the variant parser takes.
JSON_VALUE_CHARS = 20_000_000


def _head_hex(content: Column, offset: int, nbytes: int) -> Column:
    return F.hex(F.substring(content, offset + 1, nbytes))


def _zip_kind(content: Column) -> Column:
    """Refine a zip: ODF by its leading ``mimetype`` member, OOXML by the names in
    the zip's directory (a name stands 46 bytes after an entry's signature)."""
    head = F.decode(F.substring(content, 31, 100), "ISO-8859-1")
    odf = [F.when(head.startswith("mimetype" + m), F.lit(k)) for k, m in ODF_MIMES]
    names = F.decode(content, "ISO-8859-1")
    ooxml = [F.when(names.rlike("(?s)PK\\x01\\x02.{42}" + marker), F.lit(k)) for k, marker in OFFICE_ZIP_MARKERS]
    return F.coalesce(*odf, *ooxml, F.lit("zip"))


def sniff_kind(content: Column) -> Column:
    """Container/binary kind by magic bytes: gz, zip, tar, docx/xlsx/pptx,
    odp/ods/odt, ole, pdf, png, jpg, gif, bmp, tif, webp, parquet, or null."""
    expr = None
    for kind, off, magic in MAGIC:
        test = _head_hex(content, off, len(magic) // 2) == magic
        if kind == "zip":
            value = _zip_kind(content)
        elif kind == "parquet":
            test = test & (F.hex(F.substring(content, -4, 4)) == magic)
            value = F.lit(kind)
        else:
            value = F.lit(kind)
        expr = F.when(test, value) if expr is None else expr.when(test, value)
    webp = (_head_hex(content, 0, 4) == "52494646") & (_head_hex(content, 8, 4) == "57454250")
    tar = _head_hex(content, 257, 5) == "7573746172"        # 'ustar' at offset 257
    return expr.when(webp, "webp").when(tar, "tar")


def html_doc_sniff(text: Column) -> Column:
    """Full HTML document: the first 100 characters of the whitespace-collapsed
    first 10,000 characters start a ``<!doctype`` or ``<html`` tag."""
    head = F.left(F.regexp_replace(F.left(text, F.lit(10000)), f"[{WS}]+", " "), F.lit(100))
    # a tag that the collapsed text starts with stands in the text itself
    return F.left(text, F.lit(10000)).rlike(r"(?i)<(!doctype|html)") & head.rlike(r"(?i)<(!doctype|html)\b")


#: Quoting of a delimited text: (quote, escape); an empty escape doubles the quote.
QUOTINGS = [("", ""), ('"', ""), ('"', "\\"), ("'", ""), ("'", "\\")]
DIALECT = "struct<delimiter:string,quote:string,escape:string,multiline:boolean>"
_EDGE = r"[^,;\t|\r\n]"
#: A cell whose type is known: no quote at its edges, where none was understood.
_TYPED = r"""^[^"']*$|^[^"'].*[^"']$"""


def _masked(text: Column, quote: str, escape: str) -> Column:
    """The text with each quoted field, which may hold delimiters and line
    breaks, taken for one letter.  A field is quoted from edge to edge."""
    if not quote:
        return text
    if escape:
        text = F.regexp_replace(text, r"\\[\s\S]", "")
    return F.regexp_replace(text, f"(?<!{_EDGE})(?:{quote}[^{quote}]*+{quote})++(?!{_EDGE})", "q")


def _used(text: Column, quote: str, escape: str) -> Column:
    """The text can be quoted so: a field opens with the quote, an escape
    stands before one."""
    if not quote:
        return F.lit(True)
    # the plain search first: most texts end there
    return F.contains(text, F.lit(escape + quote)) & text.rlike(f"{quote}(?<!{_EDGE}{quote})")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")


def _fields(line: Column, d: str) -> Column:
    return F.split(line, "\\" + d if d in "|" else d, -1)


def _delim_count(x: Column, d: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))


def csv_dialect(text: Column) -> Column:
    """Dialect struct (delimiter, quote, escape, multiline) of a delimited text,
    else null.  Candidates are all delimiters × quotings.  One counts if there are
    at least CSV_MIN_ROWS lines and CSV_SHARE of them have as many fields as the
    first (the others are ragged).  Its score is row-pattern consistency (share of
    those lines × (fields − 1) / fields) × cell-type coherence (share of cells of a
    known type); ties go to more fields, then the earlier candidate."""
    found = []
    for quote, escape in QUOTINGS:
        found.append(F.when(_used(text, quote, escape), bind(_masked(text, quote, escape), _candidates(text, quote, escape))))
    every = F.flatten(F.filter(F.array(*found), lambda c: c.isNotNull()))
    best = F.aggregate(every, F.lit(None).cast(f"struct<score:double,fields:int,dialect:{DIALECT}>"),
                       lambda acc, c: F.when(acc.isNull() | (c["score"] > acc["score"]) | ((c["score"] == acc["score"]) & (c["fields"] > acc["fields"])), c).otherwise(acc))
    return best["dialect"]


def _candidates(text: Column, quote: str, escape: str):
    def of(masked):
        def all_delimiters(lines):
            return F.array(*[_candidate(text, masked, lines, d, quote, escape) for d in CSV_DELIMS])
        return F.filter(bind(_lines(masked), all_delimiters), lambda c: c.isNotNull())
    return of


def _candidate(text: Column, masked: Column, lines: Column, d: str, quote: str, escape: str) -> Column:
    multiline = _delim_count(text, "\n") != _delim_count(masked, "\n")
    dialect = F.struct(F.lit(d).alias("delimiter"), F.lit(quote).alias("quote"), F.lit(escape).alias("escape"), multiline.alias("multiline"))

    def scored(first):
        same = F.size(F.filter(lines, lambda x: _delim_count(x, d) == first))
        cells = F.flatten(F.transform(lines, lambda x: _fields(x, d)))
        typed = F.size(F.filter(cells, lambda x: F.trim(x).rlike(_TYPED))) / F.size(cells)
        score = same / F.size(lines) * first / (first + 1) * typed
        ok = (first >= 1) & (same >= F.size(lines) * CSV_SHARE)
        return F.when(ok, F.struct(F.round(score, 9).cast("double").alias("score"), (first + 1).cast("int").alias("fields"), dialect.alias("dialect")))

    # the first line is counted once, not once a line
    return F.when(F.size(lines) >= CSV_MIN_ROWS, bind(_delim_count(_at1(lines), d), scored))


def dialect_lines(text: Column, dialect: Column) -> Column:
    """Non-blank lines under a dialect, quoted fields as one letter."""
    out = _lines(text)
    for quote, escape in QUOTINGS[1:]:
        out = F.when((dialect["quote"] == quote) & (dialect["escape"] == escape), _lines(_masked(text, quote, escape))).otherwise(out)
    return out


def _at1(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def _json_ok(x: Column) -> Column:
    """The text parses as JSON; texts that may hold a value too long for the
    variant parser are read by the JSON reader without a length limit."""
    free = {"maxStringLen": str(2**31 - 1)}
    by_reader = F.when(F.ltrim(x).startswith("["), F.from_json(x, "array<string>", free).isNotNull()) \
                 .otherwise(F.from_json(x, "map<string,string>", free).isNotNull())
    return F.try_parse_json(x).isNotNull() | ((F.length(x) > JSON_VALUE_CHARS) & by_reader)


def is_json_doc(text: Column) -> Column:
    """Whole text is one JSON object or array."""
    t = F.regexp_replace(text, f"^[{WS}]+", "")
    # The variant parser stops after the first value, so a text of several
    # one-line values (NDJSON shape) would pass: require that it is not one.
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    several = (F.size(lines) >= 2) & F.forall(lines, lambda x: _json_ok(x))
    opens = F.startswith(t, F.lit("{")) | F.startswith(t, F.lit("["))
    return opens & _json_ok(text) & ~several


def is_ndjson(text: Column) -> Column:
    """Every non-blank line is a JSON object (at least one line)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    opens = F.regexp_replace(text, f"^[{WS}]+", "").startswith("{")
    return opens & (F.size(lines) >= 1) & F.forall(
        lines, lambda x: _json_ok(x) & F.startswith(F.ltrim(x), F.lit("{"))
        & F.rtrim(x).endswith("}"))


def with_route(df, content_col: str = "content", out: str = "route", kind_out: str | None = None, dialect_out: str | None = None):
    """DataFrame form of ``route``: the kind, the normalized text and its CSV
    dialect are projected once, the cascade reads them.  Kinds that route by
    themselves have no dialect."""
    staged = df.select("*", sniff_kind(F.col(content_col)).alias("_kind"))
    # bytes that the kind alone routes are no text: they are neither decoded nor split
    staged = staged.select("*", F.when(~F.coalesce(F.col("_kind").isin(*_BY_KIND), F.lit(False)), normalize_text(F.col(content_col))).alias("_text"))
    staged = staged.select("*", F.when(F.col("_text").isNotNull(), csv_dialect(F.col("_text"))).alias("_dialect"))
    r = _cascade(F.col("_kind"), F.col("_text"), F.col("_dialect"))
    res = staged.select("*", r.alias(out)).drop("_text")
    for name, keep in (("_kind", kind_out), ("_dialect", dialect_out)):
        res = res.withColumnRenamed(name, keep) if keep else res.drop(name)
    return res


ARCHIVES = ("gz", "zip", "tar")
IMAGES = ("png", "jpg", "gif", "bmp", "tif", "webp")
OFFICE = ("docx", "xlsx", "pptx", "odp", "ods", "ole")
#: Kinds whose route needs no look at the text.
_BY_KIND = (*ARCHIVES, *IMAGES, *OFFICE, "pdf", "parquet")


def _cascade(kind: Column, text: Column, dialect: Column) -> Column:
    return (F.when(kind.isin(*ARCHIVES), "archive")
             .when(kind.isin(*IMAGES), "image")
             .when(kind.isin(*OFFICE), "office")
             .when(kind == "pdf", "pdf")
             .when(kind == "parquet", "parquet")
             .when(is_json_doc(text), "json")
             .when(is_ndjson(text), "ndjson")
             .when(dialect.isNotNull(), "csv")
             .when(html_doc_sniff(text), "html")
             .otherwise("markdown"))


def route(content: Column) -> Column:
    """Converter route of a blob, in the reference's order: archive → image →
    office → pdf → (text) tabular: parquet / json / ndjson / csv → html →
    markdown.  Archives that yield no members fall through (decided by the
    archive explode, see ``quarry.sources.archives``)."""
    text = normalize_text(content)
    return _cascade(sniff_kind(content), text, csv_dialect(text))


OFFICE_MIME = {"docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
               "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
               "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
               "odp": "application/vnd.oasis.opendocument.presentation",
               "ods": "application/vnd.oasis.opendocument.spreadsheet",
               "ole": "application/x-ole-storage"}


def _lookup(mapping: dict, key: Column) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])[key]


def content_type(route_col: Column, kind: Column) -> Column:
    """MIME type recorded for a route.  Office files keep their own type (the
    office meta wins the merge over the PDF converter's)."""
    return (F.when(route_col == "image", _lookup(IMAGE_MIME, kind))
             .when(route_col == "office", _lookup(OFFICE_MIME, kind))
             .when(route_col == "pdf", "application/pdf")
             .when(route_col == "parquet", "application/vnd.apache.parquet")
             .when(route_col.isin("json", "ndjson"), "application/json")
             .when(route_col == "csv", "text/csv")
             .when(route_col == "html", "text/html")
             .when(route_col == "markdown", "text/markdown")
             .when(route_col == "archive", F.lit(None))
             .otherwise("unknown"))
