"""Benchmark decontamination over a distributed positional inverted index.

One pass over the corpus stores the postings (term, document, position) of all
words that the test items use, and of an end mark whose position is the
document's length.  Everything else reads the index.  Items are cut into windows
of ``window`` consecutive words (an item of fewer words is one window); the
index gives every term's count, and each window names its two rarest places.
Their postings, shifted by the place in the item, are intersected: both must
name the same diagonal (position in the document − place in the item).  On the
diagonals that are left the postings of all the item's terms are laid out, and
a run of consecutive places as long as a window is an exact phrase match.

``proximity_matches`` relaxes adjacency: the two rarest terms of an item within
``distance`` words.

Defined cases: null text has no words; an item without words has no window;
null item ids are left out of the id list but their windows still count as
hits; repeated items count once; rows that share doc_id and text share one
result and each gets its row; an empty table or benchmark gives zero hits;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_RE, lower_ascii, prepare, row_key, small, staged

WINDOW = 10
#: Places of each window whose lists are intersected.
LISTS = 2
#: Term of the end mark; no word holds this character.
END = "\x00"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(ALNUM_RE), F.lit(0))


def item_places(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items(item_id, text, …) → places(ino, n, ipos, t): one row per word of
    each distinct item, and vocabulary(term, t) with the end mark as t = -1."""
    distinct = staged(items.select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
                      .withColumn("ino", F.monotonically_increasing_id()), "bench-items")
    vocabulary = staged(distinct.select(F.explode("w").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id())
                        .unionByName(items.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(-1).cast("long").alias("t"))), "bench-terms")
    places = distinct.select("item_id", "ino", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "term")).join(vocabulary, "term")
    return staged(places.select("item_id", "ino", "n", "ipos", "t"), "bench-places"), vocabulary


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The positional index: (t, rid, pos) of every vocabulary word of every
    document, and its end mark.  The rid comes from the row's own values."""
    words = docs.select(row_key("text").alias("rid"), F.posexplode(F.concat(tokens(F.col("text")), F.array(F.lit(END)))).alias("pos", "term"))
    return staged(words.join(small(vocabulary, vocabulary.count()), "term").select("t", "rid", "pos"), "bench-postings")


def rarest_places(places: DataFrame, index: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """(ino, ipos, t, need): the places whose lists are intersected, ``lists``
    of each window.  Windows with a term that the corpus lacks can't occur."""
    counts = index.where(F.col("t") >= 0).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    w = F.least(F.lit(window), F.col("n"))
    cut = (places.join(counts, "t", "left").withColumn("w", w)
           .withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - F.col("w") + 1), F.least(F.col("ipos"), F.col("n") - F.col("w"))))))
    of = Window.partitionBy("ino", "start")
    k = F.row_number().over(of.orderBy("df", "ipos"))
    able = cut.withColumn("present", F.count("df").over(of) == F.col("w")).withColumn("k", k).where(F.col("present") & (F.col("k") <= lists))
    return able.groupBy("ino", "ipos", "t").agg(F.min(F.least(F.col("w"), F.lit(lists))).alias("need"))


def diagonals(index: DataFrame, picks: DataFrame) -> DataFrame:
    """(ino, rid, diag) on which enough of the picked places stand."""
    shifted = index.join(small(picks, picks.count()), "t").select("ino", "rid", (F.col("pos") - F.col("ipos")).alias("diag"), "need")
    return (shifted.groupBy("ino", "rid", "diag").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
            .where(F.col("n") >= F.col("need")).select("ino", "rid", "diag"))


def phrase_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """hits(rid, item_id, a, b): runs of document words [a, b) covered by
    windows of an item, and ends(rid, n_words), one row per document."""
    places, vocabulary = item_places(items)
    index = build_index(docs, vocabulary)
    picks = staged(rarest_places(places, index, window), "bench-picks")
    lines = staged(diagonals(index, picks), "bench-diagonals")
    n_places = places.count()
    # a diagonal names the position of each of its item's words: those that hold the word are looked up
    due = staged(lines.join(small(places.select("ino", "ipos", "t"), n_places), "ino").withColumn("pos", F.col("diag") + F.col("ipos")), "bench-due")
    laid = index.where(F.col("t") >= 0).join(small(due, due.count()), ["t", "rid", "pos"]).select("rid", "ino", "diag", "ipos").distinct()
    rank = F.row_number().over(Window.partitionBy("rid", "ino", "diag").orderBy("ipos"))
    runs = laid.withColumn("g", F.col("ipos") - rank).groupBy("rid", "ino", "diag", "g").agg(F.min("ipos").alias("lo"), F.count(F.lit(1)).alias("len"))
    heads = places.where(F.col("ipos") == 0).select("ino", "item_id", "n")
    hits = (runs.join(small(heads, n_places), "ino").where(F.col("len") >= F.least(F.lit(window), F.col("n")))
            .select("rid", "item_id", (F.col("diag") + F.col("lo")).alias("a"), (F.col("diag") + F.col("lo") + F.col("len")).alias("b")))
    ends = index.where(F.col("t") == -1).select("rid", F.col("pos").alias("n_words"))
    return staged(hits, "bench-hits"), ends


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, …), items(item_id, text, …) → one row per document:
    doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    prepare(docs.sparkSession)
    hits, ends = phrase_hits(docs, items, window)
    before = F.max("b").over(Window.partitionBy("rid").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(before, F.lit(0))))
    found = hits.withColumn("fresh", fresh).groupBy("rid").agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return ends.join(found, "rid", "left").select(
        F.col("rid.doc_id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, all columns kept."""
    prepare(docs.sparkSession)
    hits, _ = phrase_hits(docs, items, window)
    hit = hits.select(F.col("rid").alias("quarry_hit")).distinct()
    rows = docs.withColumn("quarry_rid", row_key("text"))
    return rows.join(hit, F.col("quarry_rid") == F.col("quarry_hit"), "left_anti").drop("quarry_rid")


def proximity_matches(docs: DataFrame, items: DataFrame, distance: int = 5) -> DataFrame:
    """(doc_id, item_id, pos_a, pos_b): the two rarest distinct terms of an item
    within ``distance`` words of each other, in either order.  The nearest
    partner on each side is reported, so a frequent term adds two rows at most
    per occurrence."""
    prepare(docs.sparkSession)
    places, vocabulary = item_places(items)
    index = build_index(docs, vocabulary)
    counts = index.where(F.col("t") >= 0).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    k = F.row_number().over(Window.partitionBy("ino").orderBy("df", "t"))
    picks = places.select("ino", "item_id", "t").distinct().join(counts, "t").withColumn("k", k).where(F.col("k") <= 2)
    hits = index.join(picks.select("ino", "item_id", "t", "k"), "t")
    by = Window.partitionBy("ino", "rid").orderBy("pos", "k")
    a = F.col("k") == 1
    other = F.when(~a, F.col("pos"))
    near = (hits.withColumn("prev", F.last(other, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("next", F.first(other, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
            .where(a).select("rid", "item_id", F.col("pos").alias("pos_a"), F.explode(F.array("prev", "next")).alias("pos_b"))
            .where(F.col("pos_b").isNotNull() & (F.abs(F.col("pos_b") - F.col("pos_a")) <= distance)))
    return near.select(F.col("rid.doc_id").alias("doc_id"), "item_id", "pos_a", "pos_b")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, least(len(w), 10) AS k, w[s:s + least(len(w), 10) - 1] AS g
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM v),
p AS (SELECT doc_id, s, k, w[s:s + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lens)),
m AS (SELECT DISTINCT p.doc_id, p.s, p.k, v.item_id FROM p JOIN v ON p.g = v.g),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
