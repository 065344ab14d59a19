"""Phrase collocation mining by top-order marginalisation.

A text is split into pieces at punctuation and line breaks and a piece into
words.  Every word starts exactly one window: the word and its lead columns, up
to ``longest`` words, padded where the piece ends.  Only these longest windows
are made; Spark's ROLLUP over their columns sums them to every shorter prefix,
so one grouped count holds the frequencies of the phrases of all lengths (a
phrase occurs as often as windows begin with it), and the empty prefix is the
number of words.

Most windows of a corpus occur once.  They are padded behind the part that can't
reach ``least``: a first pass counts hashed slots of all prefixes, saturating at ``least`` (slots are shared, so a count is never too low),
and a prefix whose slot stays under it is cut before anything is shuffled.  A
slot that is too high only keeps a window that the exact sums drop.  The bits of
the slots follow the corpus up to ``MOST_SLOTS``, the bound of what is broadcast;
beyond it more windows are left to the sums.

Windows hold 64-bit word hashes; the words come back from a dictionary of the
corpus, which also shows whether two words of a reported phrase share a hash (the
query then fails rather than add them up).

Phrases of at least ``least`` occurrences are kept; the two parts of every cut
of a frequent phrase are frequent too, so all that scoring needs is there.

Defined cases: null texts are empty; a null lang is ``und``; an empty table gives
no row; repeated rows and copies count each; other columns (doc_id included) are
not read; counts up to 10^15 keep the products inside 38 decimal digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, prepare, salted_join, small, staged
from .tokens import NOT_BLANK, PIECE_BYTES, hash_words, mix64, pieces, text_bytes

LONGEST = 3
LEAST = 10
#: A phrase goes if a longer candidate around it has this share of its count.
INSIDE_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
#: Characters that end a piece.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
#: Fills a window behind the end of its piece; word hashes are odd.
PAD = 0
#: Text bytes for which a slot is made, and the bounds of their number (bits).
BYTES_A_SLOT, FEWEST_SLOTS, MOST_SLOTS = 16, 16, 30
#: Slots summed at once.
RANGE_BITS = 20
#: Words whose windows or slots are held before they are summed.
HELD = 1 << 21
#: Parts of a language's candidates that are ranked before the last ranking.
RANK_SALTS = 32

ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in PIECE_ENDS]] = True
INSIDE = NOT_BLANK & ~ENDS


def words_in_pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (first row, row, piece, word hash, start and end byte of each word,
    bytes) for some rows of a text column."""
    data, offsets = text_bytes(column)
    for a, b in pieces(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        parts, at = [], lo
        while at < hi:  # a long text is hashed in parts cut at gaps
            end = min(at + PIECE_BYTES, hi)
            if end < hi:
                gaps = np.flatnonzero(~INSIDE[data[at:end]])
                rest = np.flatnonzero(~INSIDE[data[end:hi]]) if not len(gaps) else gaps
                end = at + int(gaps[-1]) + 1 if len(gaps) else end + int(rest[0]) if len(rest) else hi
            cut = offsets[a + 1:b]
            s, e, h = hash_words(data[at:end], cut[(cut > at) & (cut < end)] - at, INSIDE)
            parts.append((s + at, e + at, h | np.uint64(1)))
            at = end
        s, e, h = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        row = np.searchsorted(offsets[a:b + 1], s, side="right") - 1
        ends = np.flatnonzero(ENDS[data[lo:hi]]) + lo
        yield a, row, np.searchsorted(ends, s) + row, h, s, e, data


def windows_of(h: np.ndarray, piece: np.ndarray, longest: int) -> list[np.ndarray]:
    """The lead columns: word hashes, padded behind the end of a piece."""
    columns = [h]
    for k in range(1, longest):
        lead = np.full(len(h), PAD, np.uint64)
        lead[:max(len(h) - k, 0)] = np.where(piece[k:] == piece[:max(len(h) - k, 0)], h[k:], np.uint64(PAD))
        columns.append(lead)
    return columns


def prefix_slots(lang: np.ndarray, columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Slots of the prefixes of 1, 2, 3, … words, where the window has them."""
    key, out = lang, []
    for lead in columns:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + lead)
        out.append((key >> np.uint64(64 - bits)).astype(np.int64))
    return out


def set_bits(slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (slots[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def lang_hashes(column: pa.Array) -> np.ndarray:
    """A number for each row's language, equal in all tasks."""
    names = column.dictionary_encode()
    return np.array([mix64(hash_words(np.frombuffer(b"x" + n.encode(), np.uint8), np.zeros(0, np.int64), np.ones(256, bool))[2])[0] for n in names.dictionary.to_pylist()] or [0],
                    np.uint64)[names.indices.to_numpy()]


def frequent_slots(docs: DataFrame, bits: int, longest: int, least: int) -> np.ndarray:
    """Bit map of the slots that reach ``least``; counts travel as sorted,
    packed (slot, count) lists of bounded ranges of slots."""
    width = 1 << min(bits, RANGE_BITS)

    def packed(held):
        slots, n = np.unique(np.concatenate(held), return_counts=True)
        n = np.minimum(n, least).astype(np.uint8)
        cut = np.searchsorted(slots, np.arange(0, (1 << bits) + 1, width))
        for r in np.flatnonzero(np.diff(cut)):
            own = (slots[cut[r]:cut[r + 1]] - r * width).astype(np.uint32)
            # gaps by byte planes: the upper ones are nearly all zero
            gaps = np.diff(own, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()
            yield int(r), len(own), pa.compress(gaps + n[cut[r]:cut[r + 1]].tobytes(), codec="zstd", asbytes=True)

    def count(batches):
        held, size = [], 0

        def out():
            rows = list(packed(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "n", "packed"])

        for batch in batches:
            lang = lang_hashes(batch.column("lang"))
            for first, row, piece, h, *_ in words_in_pieces(batch.column("text")):
                columns = windows_of(h, piece, longest)
                for lead, slots in zip(columns, prefix_slots(lang[first + row], columns, bits)):
                    held.append(slots[lead != PAD])
                    size += len(held[-1])
                if size >= 4 * HELD:
                    yield out()
                    size = 0
        if size:
            yield out()

    def add(batches):
        at, sums = -1, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for r, n, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "packed"))):
                if r != at:
                    if sums is not None:
                        yield out()
                    at, sums = r, np.zeros(width, np.uint8)
                raw = np.frombuffer(pa.decompress(blob, 5 * n, codec="zstd", asbytes=True), np.uint8)
                slots = np.cumsum(np.ascontiguousarray(raw[:4 * n].reshape(4, n).T).view(np.uint32).ravel(), dtype=np.int64)
                sums[slots] = np.minimum(sums[slots] + raw[4 * n:], least)
        if sums is not None:
            yield out()

    lists = docs.mapInArrow(count, "part int, n int, packed binary")
    found = lists.repartition((1 << bits) // width, "part").sortWithinPartitions("part").mapInArrow(add, "part int, bits binary").toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r, bit in zip(found["part"].to_pylist(), found["bits"].to_pylist()):
        out[r * (width // 8):(r + 1) * (width // 8)] = np.frombuffer(bit, np.uint8)
    return out


def lead_windows(docs: DataFrame, slots: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """docs(lang, text) → (lang, w1 … w<longest>, c): the windows that begin at
    c words, padded behind their last prefix that may be frequent."""
    table, bits = docs.sparkSession.sparkContext.broadcast(slots), (8 * len(slots)).bit_length() - 1
    names = ["lang", *[f"w{k}" for k in range(1, longest + 1)], "c"]

    def run(batches):
        for batch in batches:
            lang, held, size = lang_hashes(batch.column("lang")), [], 0

            def out():
                row, *columns = (np.concatenate(c) for c in zip(*held))
                held.clear()
                key = lang[row]
                for c in columns:
                    key = mix64(key ^ c) * np.uint64(0x9E3779B97F4A7C15)
                order = np.argsort(key)
                row, columns = row[order], [c[order] for c in columns]
                new = np.ones(len(order), bool)
                new[1:] = lang[row[1:]] != lang[row[:-1]]
                for c in columns:
                    new[1:] |= c[1:] != c[:-1]
                begin = np.flatnonzero(new)
                return pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(row[begin])), *[pa.array(c[begin].view(np.int64)) for c in columns],
                                                   pa.array(np.diff(np.append(begin, len(order))))], names)

            for first, row, piece, h, *_ in words_in_pieces(batch.column("text")):
                columns = windows_of(h, piece, longest)
                able = np.ones(len(h), bool)
                for k, slot in enumerate(prefix_slots(lang[first + row], columns, bits)):
                    able &= set_bits(table.value, slot)
                    columns[k] = np.where(able, columns[k], np.uint64(PAD))
                held.append((first + row, *columns))
                size += len(h)
                if size >= HELD:
                    yield out()
                    size = 0
            if size:
                yield out()

    return docs.mapInArrow(run, ", ".join(["lang string", *[f"{n} long" for n in names[1:]]]))


def dictionary(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """docs(lang, text) → (h, word, other): the words that may be frequent in a
    language; ``other`` differs from ``word`` where words share a hash."""
    table, bits = docs.sparkSession.sparkContext.broadcast(slots), (8 * len(slots)).bit_length() - 1

    def run(batches):
        for batch in batches:
            lang, held = lang_hashes(batch.column("lang")), []
            for first, row, _, h, s, e, data in words_in_pieces(batch.column("text")):
                order = np.lexsort((e - s, h))
                order = order[set_bits(table.value, prefix_slots(lang[first + row], [h], bits)[0])[order]]
                h, s, e = h[order], s[order], e[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (e[1:] - s[1:] != e[:-1] - s[:-1])
                at = np.flatnonzero(new)
                words = pa.array([data[i:j].tobytes() for i, j in zip(s[at], e[at])], pa.binary())
                held.append(pa.table({"h": h[at].view(np.int64), "word": words.cast(pa.string())}))
            if held:
                yield from pa.concat_tables(held).group_by(["h", "word"]).aggregate([]).combine_chunks().to_batches()

    seen = docs.mapInArrow(run, "h long, word string").withColumn("word", lower_ascii(F.col("word")))
    return seen.distinct().groupBy("h").agg(F.min("word").alias("word"), F.max("word").alias("other"))


def slot_bits(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(size, 1) / BYTES_A_SLOT)), FEWEST_SLOTS, MOST_SLOTS))


def phrase_counts(docs: DataFrame, slots: np.ndarray, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """docs(lang, text) → (lang, words, f): every phrase (word hashes) of up to
    ``longest`` words with at least ``least`` occurrences, and per lang the empty
    phrase, counted always."""
    windows = lead_windows(docs, slots, longest)
    names = [f"w{k}" for k in range(1, longest + 1)]
    sums = docs.sparkSession.sql(
        f"SELECT lang, {', '.join(names)}, sum(c) AS f FROM {{windows}} GROUP BY lang, ROLLUP ({', '.join(names)}) HAVING sum(c) >= {int(least)} OR w1 IS NULL",
        windows=windows)
    words = F.filter(F.array(*names), lambda w: w.isNotNull())
    # a prefix that ends in padding is counted at its own length already
    return sums.withColumn("words", words).where(~F.array_contains("words", F.lit(PAD).cast("long"))).select("lang", "words", "f")


def cut_scores(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The candidates (lang, words, a) with l, r and score of their lowest cut,
    ties to the shortest first part."""
    many = counts.where(F.size("words") > 1).withColumnRenamed("f", "a")
    m = F.size("words")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("first"), F.slice("words", F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("first"), F.slice("words", k + 1, m - k).alias("part")))))
    parts = many.select("lang", "words", "a", F.inline(cuts))
    # a word is a part of up to all candidates and is salted; longer parts of at most one for each word before or behind
    whole = counts.select("lang", F.col("words").alias("part"), "f")
    n = F.size("part")
    known = salted_join(parts.where(n == 1), whole.where(n == 1), ["lang", "part"], "words").unionByName(
        parts.where(n > 1).join(whole.where(n > 1), ["lang", "part"]))
    side = [F.max(F.when((F.col("k") == k) & (F.col("first") == first), F.col("f"))).alias(f"{'l' if first else 'r'}{k}")
            for k in range(1, longest) for first in (True, False)]
    wide = known.groupBy("lang", "words", "a").agg(*side)

    def big(c) -> Column:
        return F.col(c).cast("decimal(38,0)")

    def cut(k: int) -> Column:
        score = F.call_function("div", F.lit(SCALE).cast("decimal(38,0)") * big("a") * big("a"), big(f"l{k}") * big(f"r{k}"))
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    return wide.withColumn("cut", F.array_min(F.array(*[cut(k) for k in range(1, longest)]))).select("lang", "words", "a", "cut.l", "cut.r", "cut.score")


def absorbed(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, words, around): the greatest count of a longer candidate that
    holds the phrase's words in one run."""
    m = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda n: F.transform(F.sequence(F.lit(1), m - n + 1), lambda i: F.slice("words", i, n))))
    return counts.where(m > 2).select("lang", F.explode(F.array_distinct(inner)).alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("around"))


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases(lang, words, …) with ``phrase``, the words joined by spaces."""
    places = phrases.select("lang", "words", F.posexplode("words").alias("pos", "h"))
    used = words.join(phrases.select(F.explode("words").alias("h")).distinct(), "h", "left_semi")
    clash = F.when(F.col("word") != F.col("other"), F.raise_error(F.concat(F.lit("words share a hash: "), "word", F.lit(" "), "other")).cast("string"))
    used = staged(used.select("h", F.coalesce(clash, "word").alias("word")), "phrase-words")
    text = (salted_join(places, used, ["h"], "words").groupBy("lang", "words")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    return phrases.join(text, ["lang", "words"])


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside_percent: int = INSIDE_PERCENT, top: int = TOP) -> DataFrame:
    """docs(text, lang, …) → lang, rank, phrase, a, l, r, n, score: each
    lang's first ``top`` phrases by score and a descending, phrase ascending."""
    prepare(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    slots = frequent_slots(docs, slot_bits(docs), longest, least)
    counts = staged(phrase_counts(docs, slots, longest, least), "phrase-counts")
    scored = cut_scores(counts, longest).join(absorbed(counts, longest), ["lang", "words"], "left")
    left = staged(scored.where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * inside_percent)).drop("around"), "phrase-candidates")
    left = spelled(left, dictionary(docs, slots)).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return best.join(small(totals, totals.count()), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB: each phrase length counted on its own, 128-bit products.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
win AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM spots),
total AS (SELECT lang, count(*) AS n FROM win GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM win GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM win WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM win WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT x.lang, x.w1 || ' ' || x.w2 AS phrase, x.f AS a, 1 AS k, p.f AS l, s.f AS r
  FROM f2 x JOIN f1 p ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 s ON x.lang = s.lang AND x.w2 = s.w1
  WHERE x.f >= 10 AND NOT EXISTS (
    SELECT 1 FROM f3 y WHERE y.lang = x.lang AND ((y.w1 = x.w1 AND y.w2 = x.w2) OR (y.w2 = x.w1 AND y.w3 = x.w2)) AND 100 * y.f >= 50 * x.f)
  UNION ALL
  SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 1, p.f, s.f
  FROM f3 x JOIN f1 p ON x.lang = p.lang AND x.w1 = p.w1 JOIN f2 s ON x.lang = s.lang AND x.w2 = s.w1 AND x.w3 = s.w2
  UNION ALL
  SELECT x.lang, x.w1 || ' ' || x.w2 || ' ' || x.w3, x.f, 2, p.f, s.f
  FROM f3 x JOIN f2 p ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2 JOIN f1 s ON x.lang = s.lang AND x.w3 = s.w1),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
