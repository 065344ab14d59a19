"""Line dedup by distinct-site spread.

A line is compared without surrounding whitespace and runs of blanks.  Lines
are counted by a 64-bit pair of hashes; only lines with at least ``min_sites``
occurrences can reach the threshold, so the others (nearly all) leave after one
pre-aggregated count.  For the rest a HyperLogLog sketch of the sites merges by
aggregation, map-side first.  Estimates clearly above the
threshold decide at once, estimates within the sketch's error band get an
exact distinct count, and those clearly below stay.

Boilerplate is removed across sites: each line on ``min_sites`` sites or more
keeps one occurrence, the first of the lowest doc_id, and every other one goes.

Defined cases: null text stays null; blank lines are never counted or removed;
a null source counts as one site of its own; rows with the same doc_id are
separate documents, told apart by row; an empty table gives an empty result;
extra columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_RE, let, prepare, row_key, salted_join, staged, without

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 5
#: log2 of the sketch's registers; its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 9
#: Standard errors around the threshold within which sites are counted exactly.
BAND = 4


def line_key(line: Column) -> Column:
    """Canonical form: blanks collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(line, GAP_RE, " "))


def line_hash(key: Column) -> Column:
    """128 bits of identity in two 64-bit hashes."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit("quarry")).alias("b"))


def line_table(docs: DataFrame) -> DataFrame:
    """(rid, source, n, a, b): one row per line that has a word."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: line_key(x))
    hashes = let(lines, lambda a: F.filter(
        F.transform(a, lambda k, i: F.struct(i.alias("n"), F.when(k != "", line_hash(k)).alias("h"))),
        lambda s: s["h"].isNotNull()))
    return (docs.select("rid", "source", F.explode(hashes).alias("x"))
                .select("rid", "source", F.col("x.n").alias("n"), F.col("x.h.a").alias("a"), F.col("x.h.b").alias("b")))


def frequent_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of ``lines`` whose line occurs ``min_sites`` times or more; a line
    on so many sites does.  Counts combine map-side and the join is salted, so a
    line may hold any share of the rows."""
    often = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("a", "b")
    return staged(salted_join(lines, often, ["a", "b"], "rid"), "line-frequent")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(a, b, sites): the lines on at least ``min_sites`` distinct sites."""
    site = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    sketches = staged(lines.groupBy("a", "b").agg(F.hll_sketch_agg(site, F.lit(lg_k)).alias("s"))
                      .select("a", "b", F.hll_sketch_estimate("s").alias("estimate")), "line-sketches")
    error = BAND * 1.04 / (2 ** (lg_k / 2))
    near = sketches.where(F.col("estimate").between(min_sites * (1 - error) - 1, min_sites * (1 + error) + 1)).select("a", "b")
    exact = (salted_join(lines, near, ["a", "b"], "rid").groupBy("a", "b", "source").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites))
    clear = sketches.where(F.col("estimate") > min_sites * (1 + error) + 1).select("a", "b", F.col("estimate").alias("sites"))
    return exact.select("a", "b", F.col("sites").cast("long")).unionByName(clear.select("a", "b", F.col("sites").cast("long")))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs(doc_id, text, source, …) → the same columns with the boilerplate
    lines removed from ``text``, plus n_lines (lines with a word) and n_removed."""
    prepare(docs.sparkSession)
    own = without(docs.columns, "n_lines", "n_removed")
    # a row's identity must survive recomputation, so it comes from its values; rows equal in all three share one fate
    keyed = docs.select(*own, row_key("text", "source").alias("quarry_rid"))
    lines = frequent_lines(staged(line_table(keyed.select(F.col("quarry_rid").alias("rid"), "source", "text")), "line-keys"), min_sites)
    spread = staged(spread_lines(lines, min_sites), "line-spread")
    hits = staged(salted_join(lines, spread.select("a", "b"), ["a", "b"], "rid"), "line-hits")
    first = hits.groupBy("a", "b").agg(F.min(F.struct(F.col("rid.doc_id").isNull().alias("z"), "rid", "n")).alias("f"))
    kept = first.select(F.col("f.rid").alias("rid"), F.col("f.n").alias("n"))
    gone = (hits.select("rid", "n").distinct().join(kept, ["rid", "n"], "left_anti")
            .groupBy(F.col("rid").alias("quarry_rid")).agg(F.collect_set("n").alias("quarry_gone")))
    lines_of = F.split(F.coalesce("text", F.lit("")), "\n")
    text = F.when(F.col("quarry_gone").isNull(), F.col("text")).otherwise(
        let(lines_of, lambda a: F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(a) - 1), "quarry_gone"), lambda i: a[i]), "\n")))
    n_lines = F.size(F.filter(lines_of, lambda x: line_key(x) != "")).cast("long")
    return (keyed.join(gone, "quarry_rid", "left")
            .select(*[text.alias(c) if c == "text" else F.col(c) for c in own], n_lines.alias("n_lines"),
                    F.when(F.col("quarry_gone").isNull(), 0).otherwise(F.size("quarry_gone")).cast("long").alias("n_removed")))


ORACLE = r"""
WITH l AS (SELECT doc_id, source, i - 1 AS n, trim(regexp_replace(string_split(text, chr(10))[i], '[\x20\x09-\x0D]+', ' ', 'g')) AS k
           FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
w AS (SELECT * FROM l WHERE k <> ''),
b AS (SELECT k FROM w GROUP BY k HAVING count(DISTINCT coalesce('s' || source, '-')) >= 5),
f AS (SELECT k, min((doc_id, n)) AS first FROM w WHERE k IN (SELECT k FROM b) GROUP BY k),
g AS (SELECT w.doc_id, w.n FROM w JOIN f ON w.k = f.k WHERE (w.doc_id, w.n) <> f.first),
t AS (SELECT a.doc_id, a.n, string_split(d.text, chr(10))[a.n + 1] AS line FROM l a JOIN documents d USING (doc_id)
      WHERE (a.doc_id, a.n) NOT IN (SELECT (doc_id, n) FROM g)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM t GROUP BY doc_id)
SELECT d.doc_id, (SELECT count(*) FROM w WHERE w.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id) AS n_removed,
       sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END) AS text_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
