"""Sparse suffix-array dedup: passages of ``min_words`` words or more that occur
in several documents.

Every window of ``min_words`` words is governed by one content-selected
position, the least hash among its ``ANCHOR``-word grams, so equal windows are
governed from equal offsets.  Only suffixes at those positions are retained,
some 2 / (min_words − ANCHOR + 2) of all.  They are sorted by their leading gram,
and equal neighbours from different documents survive.  A suffix stands for a
block, the run of windows that it governs.  Neighbours whose blocks are equal
match over the whole block.  Where blocks of one gram differ, matches are
extended left and right of the anchor word by word: each distinct block is laid
out once, its windows are sorted by content, and equal neighbours from
different documents match.  Matched windows that overlap and whose lowest document
is the same are chained to maximal spans, so each window keeps its own link.  Copies collapse into distinct blocks before anything is laid out, so a
group of any size costs its distinct blocks, never its pairs.

Words are compared without regard to case.  Content is compared by 64-bit
hashes of word hashes.

Defined cases: null and empty texts and texts under ``min_words`` words have no
span; passages repeated inside one document only are not reported; rows of one
doc_id count as one document; null ids count as one document of their own; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, row_key, staged
from .tokens import Grams, mix64, starts_from, word_hashes

MIN_WORDS = 50
ANCHOR = 8


def governors(gram: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value in each run of ``width`` values (the first of equals)."""
    best = np.arange(len(gram))
    span = 1
    while span * 2 <= width:
        a, b = best[:-span], best[span:]
        best = np.where(gram[a] <= gram[b], a, b)
        span *= 2
    rest = width - span
    if rest:
        a, b = best[:-rest], best[rest:]
        best = np.where(gram[a] <= gram[b], a, b)
    return best


def anchors_of(counts: np.ndarray, h: np.ndarray, min_words: int):
    """(row, key, block, first window, last window) of every retained suffix;
    window positions count words from the start of their text."""
    empty = [np.zeros(0, np.int64)] * 5
    if len(h) < min_words:
        return empty
    at = starts_from(counts)
    grams = Grams(h)
    gram = grams.runs(np.arange(len(h) - ANCHOR + 1), ANCHOR)
    gov = governors(gram, min_words - ANCHOR + 1)
    row = np.repeat(np.arange(len(counts)), counts)[:len(gov)]
    start = np.flatnonzero(np.arange(len(gov)) + min_words <= at[row + 1])
    if not len(start):
        return empty
    g, row = gov[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    s0, s1 = start[first], start[last]
    block = grams.runs(s0, s1 - s0 + min_words) ^ mix64((g[first] - s0).astype(np.uint64) + np.uint64(1))
    base = at[row[first]]
    return row[first], gram[g[first]].view(np.int64), block.view(np.int64), s0 - base, s1 - base


def sparse_suffixes(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, key, block, s0, s1): the retained suffixes of all documents."""
    def run(batches):
        for batch in batches:
            rid = batch.column("rid")
            for first, counts, h in word_hashes(batch.column("text")):
                row, key, block, s0, s1 = anchors_of(counts, h, min_words)
                if len(row):
                    yield pa.RecordBatch.from_arrays([rid.take(pa.array(row + first)), pa.array(key), pa.array(block),
                                                      pa.array(s0.astype(np.int32)), pa.array(s1.astype(np.int32))], ["rid", "key", "block", "s0", "s1"])

    kind = docs.select("rid").schema["rid"].dataType.simpleString()
    return docs.select("rid", "text").mapInArrow(run, f"rid {kind}, key long, block long, s0 int, s1 int")


def block_windows(laid: DataFrame, min_words: int) -> DataFrame:
    """laid(text, blocks: array of s0, s1, block, lo, hi) → (window, block, at,
    lo, hi): the content hash of every window of each block, ``at`` counted from
    the block's start."""
    def run(batches):
        for batch in batches:
            lists = batch.column("blocks")
            cut, items = lists.offsets.to_numpy(), lists.values
            s0, s1 = items.field("s0").to_numpy(), items.field("s1").to_numpy()
            for first, counts, h in word_hashes(batch.column("text")):
                if not len(h):
                    continue
                grams, begin = Grams(h), starts_from(counts)
                own = cut[first:first + len(counts) + 1]
                item = np.arange(own[0], own[-1])
                row = np.repeat(np.arange(len(counts)), np.diff(own))
                n = (s1[item] - s0[item] + 1).astype(np.int64)
                which = np.repeat(np.arange(len(item)), n)
                step = np.arange(len(which)) - np.repeat(starts_from(n)[:-1], n)
                window = grams.runs(begin[row[which]] + s0[item[which]] + step, min_words)
                take = pa.array(item[which])
                yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), items.field("block").take(take), pa.array(step.astype(np.int32)),
                                                  items.field("lo").take(take), items.field("hi").take(take)], ["window", "block", "at", "lo", "hi"])

    kind = laid.schema["blocks"].dataType.elementType["lo"].dataType.simpleString()
    return laid.select("text", "blocks").mapInArrow(run, f"window long, block long, at int, lo {kind}, hi {kind}")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text, …) → one row per maximal span of repeated windows
    that share their lowest document: doc_id, start_word, end_word (exclusive),
    n_words, first_doc_id (that lowest document) and is_first (this is that
    document).  Spans of different first documents may overlap."""
    prepare(docs.sparkSession)
    keyed = docs.select("doc_id", "text", row_key("text").alias("rid"))
    suffixes = staged(sparse_suffixes(keyed, min_words), "suffixes")
    doc = F.struct(F.col("rid.doc_id").isNotNull().alias("real"), F.col("rid.doc_id").alias("doc_id"))
    # equal neighbours collapse: one row per distinct block with the lowest and highest document that has it
    blocks = staged(suffixes.groupBy("key", "block").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"), F.min(F.struct("rid", "s0", "s1")).alias("one")), "suffix-blocks")
    keys = (blocks.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n"))
            .where((F.col("n") > 1) & (F.col("lo") != F.col("hi"))).select("key"))
    whole = blocks.where(F.col("lo") != F.col("hi"))
    laid = (blocks.join(keys, "key", "left_semi").groupBy(F.col("one.rid").alias("r"))
            .agg(F.collect_list(F.struct(F.col("one.s0").alias("s0"), F.col("one.s1").alias("s1"), "block", "lo", "hi")).alias("blocks"))
            .join(keyed.select("rid", "text"), F.col("r") == F.col("rid")))
    windows = staged(block_windows(laid, min_words), "suffix-windows")
    same = (windows.groupBy("window").agg(F.min("lo").alias("low"), F.max("hi").alias("high")).where(F.col("low") != F.col("high")).select("window", "low"))
    hit = windows.join(same, "window").select("block", "at", F.col("low.doc_id").alias("first"))
    # runs of matched windows inside a block: neighbours differ by the same amount as their ranks
    rank = F.row_number().over(Window.partitionBy("block", "first").orderBy("at"))
    runs = hit.withColumn("g", F.col("at") - rank).groupBy("block", "first", "g").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    part = runs.groupBy("block").agg(F.collect_list(F.struct("a", "b", "first")).alias("runs"))
    # a block alone at its gram holds all windows that the gram governs; those of others are known window by window
    full = whole.join(keys, "key", "left_anti").groupBy("block").agg(F.min("lo").alias("lo"), F.max(F.col("one.s1") - F.col("one.s0")).alias("b"))
    full = full.select("block", F.array(F.struct(F.lit(0).alias("a"), "b", F.col("lo.doc_id").alias("first"))).alias("runs"))
    matched = staged(part.unionByName(full).groupBy("block").agg(F.flatten(F.collect_list("runs")).alias("runs")), "suffix-runs")
    places = suffixes.join(matched, "block").select("rid", "s0", F.explode("runs").alias("x"))
    places = places.select("rid", (F.col("s0") + F.col("x.a")).alias("a"), (F.col("s0") + F.col("x.b") + min_words).alias("b"), F.col("x.first").alias("first"))
    # overlapping places of one document with one first document chain to one span
    order = Window.partitionBy("rid", "first").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = (places.withColumn("new", F.coalesce((reach <= F.col("a")).cast("int"), F.lit(1)))
             .withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .groupBy("rid", "first", "g").agg(F.min("a").alias("a"), F.max("b").alias("b")))
    return spans.select(F.col("rid.doc_id").alias("doc_id"), F.col("a").alias("start_word"), F.col("b").alias("end_word"),
                        (F.col("b") - F.col("a")).alias("n_words"), F.col("first").alias("first_doc_id"),
                        F.col("first").eqNullSafe(F.col("rid.doc_id")).alias("is_first"))
