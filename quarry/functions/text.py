"""Text and markdown scalars as Spark Column expressions (JVM side, no UDFs).

Covers text normalization, bare-URL linkify, link extraction, the chunk
splitter, chunk hashing and markdown reference resolution.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import CHUNK_TARGET


def _ws_class_body() -> str:
    """Character-class body equal to Python's ``str.isspace`` (the rule the
    reference's ``strip`` and ``\\s`` use).  Built from the rule, written with
    ``\\x{..}`` escapes that both Java regex and RE2 accept."""
    cps = [c for c in range(0x110000) if chr(c).isspace()]
    ranges, start, prev = [], cps[0], cps[0]
    for c in cps[1:]:
        if c == prev + 1:
            prev = c
            continue
        ranges.append((start, prev))
        start = prev = c
    ranges.append((start, prev))
    out = []
    for a, b in ranges:
        out.append(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}")
    return "".join(out)


WS = _ws_class_body()                      # body of [...] for Python whitespace
STRIP_RE = f"^[{WS}]+|[{WS}]+$"            # Python str.strip() as a regex

# Fixed patterns that must equal the reference's behaviour.
# Bare URL: http(s):// then no whitespace, ')', ']', '>' or '"'; not right
# after '](' , '(' or '"'; case-insensitive.
BARE_URL_JAVA = f'(?i)(?<!\\]\\()(?<!\\()(?<!")(https?://[^{WS}\\)\\]>"]+)'
# Markdown link / image: [text](target)
MD_LINK_RE = r"\[([^\]]*)\]\(([^)]+)\)"
# Markdown reference with optional image bang: (!?)[text](target)
MD_REF_RE = r"(!?)\[([^\]]*)\]\(([^)]+)\)"
# Chunk separators, coarse to fine: newline before a heading, blank line,
# newline, sentence end, space.
SEPARATORS = ["\n#", "\n\n", "\n", ". ", " "]


def bind(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once per row however often it is used."""
    return F.transform(F.array(value), body)[0]


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` semantics (Unicode whitespace incl. \\x1c-\\x1f)."""
    return F.regexp_replace(c, STRIP_RE, "")


def normalize_text(content: Column) -> Column:
    """Bytes → text: UTF-8 when valid, else latin-1; CRLF / CR → LF."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    text = F.coalesce(utf8, F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def linkify(md: Column) -> Column:
    """Wrap bare http(s) URLs as ``[u](u)`` (not idempotent, like the source)."""
    return F.when(md.rlike("(?i)https?://"), F.regexp_replace(md, BARE_URL_JAVA, "[$1]($1)")).otherwise(md)


def extract_links(md: Column) -> Column:
    """Targets of all ``[text](target)`` links and images, in order."""
    return F.regexp_extract_all(md, F.lit(MD_LINK_RE), 2)


def content_sha256(c: Column) -> Column:
    """SHA-256 hex of a string (UTF-8 bytes) or binary column."""
    return F.sha2(c, 256)


# ---------------------------------------------------------------- splitter

def _split_keep(c: Column, sep: str) -> Column:
    """The text cut at every separator, separators kept as pieces of their own
    (a newline before a heading is a piece, the heading's ``#`` is not).  Every
    character falls into exactly one piece, whatever the text holds."""
    at, kept = (r"\n(?=#)", "\n") if sep == "\n#" else (sep.replace(".", r"\."), sep)
    pieces = F.flatten(F.transform(F.split(c, at), lambda p, i: F.when(i == 0, F.array(p)).otherwise(F.array(F.lit(kept), p))))
    return F.filter(pieces, lambda p: p != "")


def split_parts(text: Column, target: int = CHUNK_TARGET) -> Column:
    """Phase 1: only oversize pieces are split, by ever finer separators."""
    parts = F.array(text)
    for sep in SEPARATORS:
        parts = F.flatten(F.transform(parts, _split_oversize(sep, target)))
    return parts


def _split_oversize(sep: str, target: int):
    def f(p):
        return F.when(F.length(p) <= target, F.array(p)).otherwise(_split_keep(p, sep))
    return f


def _merge_step(target: int):
    def step(acc, n):
        flush = (acc["cur"] > 0) & (acc["cur"] + n > target)
        return F.when(
            flush,
            F.struct(F.array_append(acc["m"], F.struct(acc["s"].alias("s"), acc["cur"].alias("n"))).alias("m"),
                     (acc["s"] + acc["cur"]).alias("s"),
                     n.alias("cur")),
        ).otherwise(
            F.struct(acc["m"].alias("m"), acc["s"].alias("s"), (acc["cur"] + n).alias("cur")))
    return step


def chunk_fold(text: Column, target: int = CHUNK_TARGET) -> Column:
    """Phase 2 over part lengths: greedy merge to ≤ target.

    The pieces are contiguous slices of ``text``, so the merge only needs
    their lengths; each chunk is a (start, length) pair cut out afterwards.
    That keeps the fold free of string copies.  Returns the fold state
    struct(m: closed chunks, s: open start, cur: open length)."""
    lengths = F.transform(split_parts(text, target), lambda p: F.length(p))
    zero = F.struct(
        F.array().cast("array<struct<s:int,n:int>>").alias("m"),
        F.lit(1).alias("s"),
        F.lit(0).alias("cur"))
    return F.aggregate(lengths, zero, _merge_step(target))


def bounds_from_fold(text: Column, folded: Column) -> Column:
    """Closed chunks plus the open one when it has non-blank text."""
    last = F.struct(folded["s"].alias("s"), folded["cur"].alias("n"))
    last_text = py_strip(F.substring(text, folded["s"], folded["cur"]))
    return F.when(last_text != "", F.array_append(folded["m"], last)).otherwise(folded["m"])


def chunks_from_bounds(text: Column, bounds: Column, target: int = CHUNK_TARGET) -> Column:
    cut = F.transform(bounds, lambda b: py_strip(F.substring(text, b["s"], b["n"])))
    return F.when(F.length(text) <= target, F.array(text)).otherwise(cut)


def split_markdown(text: Column, target: int = CHUNK_TARGET) -> Column:
    """Chunk splitter: texts ≤ target are returned whole and unstripped;
    longer texts are split on separators, greedily merged, each part
    stripped.  (Single-expression form; ``split_column`` evaluates the fold
    once per row when the text is a DataFrame column.)"""
    return chunks_from_bounds(text, bounds_from_fold(text, chunk_fold(text, target)), target)


def split_column(df, text_col: str, out_col: str, target: int = CHUNK_TARGET):
    """Add ``out_col`` = chunk list of ``text_col``.  The fold is projected as
    its own column first, so its fields are read from one evaluation
    (Catalyst keeps a non-trivial projection referenced several times)."""
    t = F.col(text_col)
    staged = df.withColumn("_fold", F.when(F.length(t) > target, chunk_fold(t, target)))
    staged = staged.withColumn("_bounds", bounds_from_fold(t, F.col("_fold")))
    return staged.withColumn(out_col, chunks_from_bounds(t, F.col("_bounds"), target)).drop("_fold", "_bounds")


# ------------------------------------------------------- markdown references

# Fixed value: a content reference.
HEX64_RE = "^[a-f0-9]{64}$"


def resolve_markdown_refs(md: Column, base: Column | None = None) -> Column:
    """Markdown refs: absolute http(s) targets and 64-hex content refs stay.  With
    a ``base`` URL relative targets are joined to it; without one (or where it is
    null) relative images are removed and relative links stay."""
    if base is not None:
        return F.when(base.isNotNull(), _joined_refs(md, base)).otherwise(resolve_markdown_refs(md))
    # Scan like the reference: every ref is matched whole, left to right; a
    # relative image (group 1) is replaced by nothing, any other ref (group 2)
    # is written back unchanged.
    pat = (r"(!\[[^\]]*\]\((?!https?://)(?![a-f0-9]{64}\n?\))[^)]+\))"
           r"|(!?\[[^\]]*\]\([^)]+\))")
    return F.when(md.contains("]("), F.regexp_replace(md, pat, "$2")).otherwise(md)


def _joined_refs(md: Column, base: Column) -> Column:
    from .urls import absolutize

    def joined(ref):
        target = F.regexp_extract(ref, r"^!?\[[^\]]*\]\(([^)]+)\)$", 1)
        head = F.substring(ref, F.lit(1), F.length(ref) - F.length(target) - 1)
        stays = target.rlike(r"^(https?://|[a-f0-9]{64}\n?\z)")
        return F.when(stays, ref).otherwise(F.concat(head, absolutize(target, base), F.lit(")")))
    return replace_each(md, MD_REF_RE, joined)


def markdown_images(md: Column) -> Column:
    """Distinct absolute http(s) image URLs among the refs of a markdown text
    (refs are scanned whole, left to right, as the resolver does)."""
    refs = F.regexp_extract_all(md, F.lit(MD_REF_RE), 0)
    imgs = F.filter(refs, lambda r: r.startswith("!["))
    targets = F.transform(imgs, lambda r: F.regexp_extract(r, r"^!\[[^\]]*\]\(([^)]+)\)$", 1))
    return F.array_distinct(F.filter(targets, lambda t: t.rlike("^https?://")))


# ------------------------------------------------------------ data URIs

# base64 text of whole quads, an inline image attribute.
QUADS_RE = r"\A[A-Za-z0-9+/]*+={0,2}\z"
DATA_URI_RE = r"""(?i)(src\s*=\s*)(["'])data:image/([^;]+);base64,([^"']+)\2"""


def data_uri_payloads(html: Column) -> Column:
    """Base64 payloads of ``src="data:image/...;base64,..."`` attributes."""
    return F.regexp_extract_all(html, F.lit(DATA_URI_RE), 4)


def encode_b64(b: Column) -> Column:
    """Bytes → base64 text on one line (Spark may wrap at 76 characters)."""
    return F.replace(F.replace(F.base64(b), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))


def decode_b64(s: Column) -> Column:
    """Base64 text → bytes; null when undecodable."""
    return F.try_to_binary(s, F.lit("base64"))


def whole_quads(payloads: Column) -> Column:
    """Array of base64 texts → what a non-validating decoder (the reference's
    default) reads of each: characters outside the alphabet are skipped; the data
    must end on a full quad or be completed by padding ('=' × 2 after two, × 1
    after three characters); otherwise null.  Padding inside the data is treated as
    trailing.  One pass an element; no lambda holds another (Python functions
    can't take such arguments)."""
    whole = lambda t: (F.length(t) % 4 == 0) & t.rlike(QUADS_RE)
    cleaned = F.transform(payloads, lambda p: F.when(whole(p), p).otherwise(F.regexp_replace(p, "[^A-Za-z0-9+/=]+", "")))

    def completed(c):
        data = F.replace(c, F.lit("="), F.lit(""))
        n = F.length(data)
        pads = F.length(c) - n
        r = n % 4
        ok = (r == 0) | ((r == 2) & (pads >= 2)) | ((r == 3) & (pads >= 1))
        return F.when(ok, F.concat(data, F.repeat(F.lit("="), (4 - r) % 4)))
    return F.transform(cleaned, lambda c: F.when(whole(c), c).otherwise(completed(c)))


def decode_b64_lenient(s: Column) -> Column:
    """Non-validating base64 decode (see ``whole_quads``); null when undecodable."""
    return F.unbase64(whole_quads(F.array(s))[0])


def replace_each(c: Column, pattern: str, fix) -> Column:
    """Rewrite every match of ``pattern`` by ``fix(match)``, null leaving it as it
    is: the pieces between the matches and the matches are zipped back."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    between = F.split(c, pattern, -1)
    fixed = F.transform(found, lambda m: F.coalesce(fix(m), m))
    return F.array_join(F.transform(F.arrays_zip(between.alias("t"), fixed.alias("m")),
                                    lambda z: F.concat(z["t"], F.coalesce(z["m"], F.lit("")))), "")


def replace_data_uris(html: Column) -> Column:
    """Replace each decodable data-URI image by its content-hash reference;
    undecodable payloads stay as they were.  ``html`` is read several times:
    project a costly one first."""
    match, head, quote, payload = (F.regexp_extract_all(html, F.lit(DATA_URI_RE), F.lit(i)) for i in (0, 1, 2, 4))
    sha = F.transform(whole_quads(payload), lambda p: F.sha2(F.unbase64(p), 256))
    parts = F.arrays_zip(F.split(html, DATA_URI_RE, -1).alias("t"), match.alias("m"), head.alias("a"), quote.alias("q"), sha.alias("s"))
    return F.array_join(F.transform(parts, lambda z: F.concat(z["t"], F.coalesce(F.concat(z["a"], z["q"], z["s"], z["q"]), z["m"], F.lit("")))), "")


# ------------------------------------------------------ model response split

def ocr_section(resp: Column) -> Column:
    """Text between ``OCR:`` and ``DESC:`` of an image-description response."""
    return py_strip(F.regexp_extract(resp, r"(?s)OCR:(.*?)(?:\nDESC:|$)", 1))


def desc_section(resp: Column) -> Column:
    return py_strip(F.regexp_extract(resp, r"(?s)\nDESC:(.*)$", 1))
