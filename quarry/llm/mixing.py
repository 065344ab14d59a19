"""Mixing sources to target weights.

Every document gets a hash-random key.  Within its source the key order is a
random order that reruns reproduce; the key's leading hex digits cut that order
into ranges, so a source that holds a third of all rows spreads over 4,096
ranges.  Range totals give each range its offset, a window inside the range
gives the exact prefix sum, and the cut falls at the source's exact budget:
whole epochs first, then the documents before the cut, the last one in part.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; sources without words get target 0; an empty table gives an
empty result; repeated rows are separate documents; equal keys are ordered by
size, which leaves rows that can't be told apart.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, prepare, staged, without

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hex digits of the key that name its range.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) → adds target: shares of the summed size by weight
    (dealt in code-point order of the source), none above ``max_epochs`` times
    its source; the excess goes to the others by weight.

    The fixed point is found in one pass: sources sorted by the level at which
    they are full; a source is full if the level left by those before it
    reaches its own."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("w", F.element_at(deal, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("total", F.sum("source_size").over(everything))
          .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
          .withColumn("w_from", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
          .withColumn("full", F.col("cap") / F.col("w") <= (F.col("total") - F.col("cap_before")) / F.col("w_from")))
    t = (t.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything))
          .withColumn("w_open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)))
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("total") - F.col("cap_full")) / F.col("w_open") * F.col("w"))
    return t.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source, …) → one row per document: doc_id, source,
    size, source_size, target, taken (words of it in the mix, repeats counted),
    and the ``carry`` columns."""
    prepare(docs.sparkSession)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"), *carry)
    base = staged(sized, "mix-sizes").withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = staged(base.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    cuts = (ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
            .select(F.col("r.source").alias("s"), F.col("range").alias("rg"), "offset", "source_size", "target", epochs.alias("epochs"))
            .withColumn("left_over", budget - F.col("epochs") * F.col("source_size")))
    within = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = base.withColumn("upto", F.sum("size").over(within))
    out = run.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("rg")))
    rest = F.col("left_over") - F.col("offset") - (F.col("upto") - F.col("size"))
    taken = F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents of the mix, all columns kept, plus size, source_size,
    target and taken.  A document that the cut leaves out is not returned."""
    mine = ("size", "source_size", "target", "taken")
    others = [c for c in without(docs.columns, *mine) if c not in ("doc_id", "source")]
    packed = docs.select("doc_id", "source", "text", F.struct(*others).alias("quarry_carry"))
    out = mix_sources(packed, weights, max_epochs, ("quarry_carry",)).where(F.col("taken") > 0)
    return out.select(*[F.col(c) if c in ("doc_id", "source") else F.col("quarry_carry")[c].alias(c) for c in without(docs.columns, *mine)], *mine)


ORACLE = r"""
WITH b AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source),
w AS (SELECT *, source_size * 3.0::DOUBLE AS cap,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before FROM w),
f AS (SELECT *, cap / w <= (total - cap_before) / (w_all - w_before) AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
        (total - (SELECT coalesce(sum(cap), 0) FROM f WHERE is_full)) / (SELECT sum(w) FROM f WHERE NOT is_full) * w END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT b.*, sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM b)
SELECT doc_id, size, e.source_size, e.target,
       CAST(epochs * size + least(size, greatest(0, floor(target + 0.5) - epochs * e.source_size - before)) AS BIGINT) AS taken
FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""
