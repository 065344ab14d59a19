"""Vectorised tokenising of Arrow text columns.

A column is read as its UTF-8 bytes; word boundaries and 64-bit word hashes are
found with numpy over pieces of bounded size, so a task's memory follows the
piece and the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

#: True for bytes inside a word.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Base of the hashes of word runs.
_RUN_BASE = 0xD1342543DE82EF95
_RUN_INVERSE = pow(_RUN_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer text stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def _hash_piece(data: np.ndarray, starts_of_rows: np.ndarray, inside: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words in ``data``; no word crosses a row start."""
    s, _, h = hash_words(data, starts_of_rows, inside, lower)
    return s, h


def hash_words(data: np.ndarray, starts_of_rows: np.ndarray, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words in ``data``; no word crosses a row start."""
    n = len(data)
    flags = inside[data]
    begins, ends = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1]
    ends[:-1] &= ~flags[1:]
    cut = starts_of_rows[(starts_of_rows > 0) & (starts_of_rows < n)]
    begins[cut] = flags[cut]
    ends[cut - 1] = flags[cut - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((LOWER[data] if lower else data).astype(np.uint64) * power[:n] + power[:n], out=sums[1:])
    return s, e, mix64((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))


def _long_text(data: np.ndarray, inside: np.ndarray, lower: bool) -> np.ndarray:
    """Word hashes of one text of any length, cut at gaps into pieces."""
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~inside[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the piece: go on to its end
                rest = np.flatnonzero(~inside[data[end:]])
                end = end + int(rest[0]) if len(rest) else len(data)
        out.append(_hash_piece(data[at:end], np.zeros(0, np.int64), inside, lower)[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(column: pa.Array, inside: np.ndarray = NOT_BLANK, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, words per row, hashes of all words in row order)."""
    data, offsets = text_bytes(column)
    for a, b in pieces(offsets):
        lo, hi = offsets[a], offsets[b]
        if b == a + 1 and hi - lo > PIECE_BYTES:
            h = _long_text(data[lo:hi], inside, lower)
            yield a, np.array([len(h)]), h
            continue
        local = offsets[a:b + 1] - lo
        s, h = _hash_piece(data[lo:hi], local[1:-1], inside, lower)
        yield a, np.diff(np.searchsorted(s, local)), h


def starts_from(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


class Grams:
    """Hashes of word runs of any length over one array of word hashes."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        up, down = np.full(n + 1, _RUN_BASE, np.uint64), np.full(n + 1, _RUN_INVERSE, np.uint64)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * np.multiply.accumulate(up)[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, length) -> np.ndarray:
        return mix64((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length, np.uint64))
