"""SQL fragments for the DuckDB oracle.

The oracle restates each query in plain SQL over the driver's parquet views so
a second engine checks every result.  Helpers here generate the longer
expressions (chunk splitter, strip, derived tables) from the same fixed
parameters as the Spark side.
"""

from __future__ import annotations

from ..functions.text import SEPARATORS, STRIP_RE, WS
from ..session import CHUNK_TARGET
from .tables import AS_OF, EPOCH


def q(s: str) -> str:
    """SQL string literal (backslashes are literal in DuckDB strings)."""
    return "'" + s.replace("'", "''") + "'"


def lit_text(s: str) -> str:
    """SQL expression for a text that may hold control characters."""
    pieces, buf = [], ""
    for ch in s:
        if ch.isprintable() and ch != "'":
            buf += ch
        else:
            if buf:
                pieces.append(q(buf))
                buf = ""
            pieces.append(f"chr({ord(ch)})")
    if buf:
        pieces.append(q(buf))
    return "||".join(pieces) if pieces else "''"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(STRIP_RE)}, '', 'g')"


def sha(x: str) -> str:
    return f"sha256({x})"


def ts_plus(base: str, secs: str) -> str:
    return f"(TIMESTAMP {q(base)} + to_seconds({secs}))"


def split_parts(x: str, target: int = CHUNK_TARGET) -> str:
    parts = f"[{x}]"
    for sep in SEPARATORS:
        if sep == "\n#":
            marked = "replace(p, chr(10)||'#', chr(1)||chr(10)||chr(1)||'#')"
        else:
            s = lit_text(sep)
            marked = f"replace(p, {s}, chr(1)||{s}||chr(1))"
        parts = (f"flatten(list_transform({parts}, lambda p: CASE WHEN length(p) <= {target} "
                 f"THEN [p] ELSE string_split({marked}, chr(1)) END))")
    return parts


def chunk_fold(x: str, target: int = CHUNK_TARGET) -> str:
    """Greedy merge over part lengths → struct(m: list of (s, n), s, cur)."""
    lengths = f"list_transform({split_parts(x, target)}, lambda p: length(p))"
    zero = "{'m': []::STRUCT(s BIGINT, n BIGINT)[], 's': 1::BIGINT, 'cur': 0::BIGINT}"
    step = (f"lambda acc, n: CASE WHEN acc.cur > 0 AND acc.cur + n > {target} "
            "THEN {'m': list_append(acc.m, {'s': acc.s, 'n': acc.cur}), 's': acc.s + acc.cur, 'cur': n} "
            "ELSE {'m': acc.m, 's': acc.s, 'cur': acc.cur + n} END")
    return f"list_reduce({lengths}, {step}, {zero})"


def split_markdown_from_fold(text: str, fold: str, target: int = CHUNK_TARGET) -> str:
    """Chunk list given the text column and a column holding ``chunk_fold``."""
    last = f"substring({text}, {fold}.s, {fold}.cur)"
    bounds = (f"CASE WHEN {strip(last)} <> '' THEN list_append({fold}.m, {{'s': {fold}.s, 'n': {fold}.cur}}) "
              f"ELSE {fold}.m END")
    cut = f"list_transform({bounds}, lambda b: {strip(f'substring({text}, b.s, b.n)')})"
    return f"CASE WHEN length({text}) <= {target} THEN [{text}] ELSE {cut} END"


def chunks_cte(src: str, text: str = "text", key: str = "file_sha256",
               target: int = CHUNK_TARGET, name: str = "fc") -> str:
    """CTE text producing ``name(file_sha256, idx, markdown, chunk_sha256)``
    from a relation ``src`` with columns ``key`` and ``text``."""
    return f"""
{name}_fold AS (SELECT {key} AS file_sha256, {text} AS text,
   CASE WHEN length({text}) <= {target} THEN NULL ELSE {chunk_fold(text, target)} END AS fold
   FROM {src}),
{name}_arr AS (SELECT file_sha256, {split_markdown_from_fold('text', 'fold', target)} AS arr FROM {name}_fold),
{name} AS (SELECT file_sha256, CAST(i - 1 AS BIGINT) AS idx, arr[i] AS markdown, sha256(arr[i]) AS chunk_sha256
   FROM (SELECT file_sha256, arr, generate_subscripts(arr, 1) AS i FROM {name}_arr))"""


# ---------------------------------------------------------- derived tables

FILES_CTE = f"""
files AS (
  SELECT sha256, r.text AS markdown, r.doc_id AS doc_id,
    {ts_plus(EPOCH, 'r.doc_id * 60')} AS created_at,
    CASE WHEN r.quality IS NOT NULL THEN {ts_plus(EPOCH, 'r.doc_id * 60 + 30')} END AS parsed_at,
    CASE WHEN r.quality = 1 THEN {ts_plus(EPOCH, 'r.doc_id * 60 + 45')} END AS indexed_at
  FROM (SELECT sha256(d.text) AS sha256,
               arg_min({{'doc_id': d.doc_id, 'text': d.text, 'quality': l.quality}}, d.doc_id) AS r
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1))"""

SOURCES_CTE = f"""
sources AS (
  SELECT source, CAST(doc_id AS VARCHAR) AS source_id, sha256(text) AS file_sha256,
    {ts_plus(EPOCH, 'doc_id * 60')} AS created_at,
    {ts_plus(EPOCH, 'doc_id * 3600')} AS touched_at
  FROM documents)"""

URL_FILES_CTE = f"""
url_files AS (
  SELECT url, url AS resolved_url, sha256(html) AS file_sha256,
    {ts_plus(EPOCH, 'page_id * 1800')} AS fetched_at
  FROM pages)"""

FILE_FILES_CTE = """
file_files AS (
  SELECT sha256('conv:' || CAST(conv_id AS VARCHAR)) AS parent_sha256,
         sha256(text) AS child_sha256, turn
  FROM conversations)"""

AS_OF_SQL = f"TIMESTAMP {q(AS_OF)}"
WS_SQL = WS
