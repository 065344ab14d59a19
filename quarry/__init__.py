"""quarry: document ingestion and retrieval expressed as Spark DataFrame plans.

Files, pages, archives and tables come in as DataFrames (or streams), are
identified by content hash, routed and converted to markdown, split into
ordered deduplicated chunks, tracked in plain lifecycle tables and searched
by tenant-scoped text, trigram and vector queries.

Common entry points::

    from quarry import build_session, intake, with_route, dedup_files, file_chunks
    from quarry import trigram_search, bm25, cosine_top_k, rrf, scoped_chunks, context_window
"""

__version__ = "0.1.0"

from .functions.html import html_metadata, html_to_markdown  # noqa: E402,F401
from .functions.sniff import route, sniff_kind, with_route  # noqa: E402,F401
from .functions.text import extract_links, linkify, normalize_text, split_markdown  # noqa: E402,F401
from .operators.chunking import dedup_files, distinct_chunks, file_chunks  # noqa: E402,F401
from .operators.lifecycle import (asof_latest, freshness_lookup, orphan_generations,  # noqa: E402,F401
                                  readiness, referential_check)
from .operators.search import (bm25, context_window, cosine_top_k, ivf_top_k, lineage, regex_search, rrf,  # noqa: E402,F401
                               scoped_chunks, substring_search, trigram_search)
from .operators.text_index import build_term_index, build_trigram_index  # noqa: E402,F401
from .operators.tabular import file_row_index, row_index, table_chunks  # noqa: E402,F401
from .operators.store import BlobStore, insert_if_absent, latest_by_key, upsert  # noqa: E402,F401
from .session import build_session  # noqa: E402,F401
from .sources.archives import explode_archives  # noqa: E402,F401
from .sources.intake import intake  # noqa: E402,F401

__all__ = [
    "build_session", "intake", "route", "sniff_kind", "with_route", "normalize_text", "linkify", "extract_links",
    "split_markdown", "html_to_markdown", "html_metadata", "dedup_files", "file_chunks", "distinct_chunks",
    "explode_archives", "freshness_lookup", "asof_latest", "readiness", "orphan_generations", "referential_check",
    "upsert", "insert_if_absent", "latest_by_key", "BlobStore", "cosine_top_k", "ivf_top_k", "trigram_search",
    "substring_search", "regex_search", "build_trigram_index", "build_term_index", "file_row_index", "row_index",
    "table_chunks", "bm25", "rrf", "scoped_chunks", "lineage", "context_window",
]
