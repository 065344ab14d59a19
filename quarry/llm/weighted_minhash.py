"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (lower-cased runs of letters and
digits), weighted by (1 + ln tf) · idf.  Document frequencies are counted over
all documents in ``2 ** DF_BITS`` hashed slots, as hashed term frequencies do, and
idf = 1 + ln(N / df) / ln(2 ** DF_BITS), at least 1: a common passage weighs less
than a text's own words, by a bounded factor at any corpus size.

Improved consistent weighted sampling draws ``BANDS × ROWS`` samples; two texts
share a sample with a probability of their weighted Jaccard similarity.  Samples
are grouped into bands.  Texts that share a band meet in a bucket.  Each is compared
with the bucket's lowest document.  In buckets that then still hold several
classes, members of different classes are paired by an exact prefix filter: a
pair at the threshold must share one of its rarest shingles, so members meet by
those alone and no pair that shares a band and could join two classes is left
out.  Every candidate is verified by the weighted
Jaccard similarity of the full shingle sets.  Verified links are closed to
classes by rounds of label exchange, each written to the shared folder.

Equal word sequences collapse to one representative before anything else, so
copies cost one row each.

Defined cases: null texts and texts without a word have no shingle and are
classes of their own; a text under five words is one shingle; rows of one doc_id
count as one document, linked if any of its texts is; null ids share one row
without a class; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, salted_join, shuffled, staged
from .tokens import ALNUM, Grams, mix64, starts_from, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 6
DF_BITS = 18
#: Bits of the outlines by which unlike pairs are passed over.
OUTLINE_BITS = 1024
#: Texts of one shingle for which a part is made.
HOT = 512
#: Rows of a key table that may be sent to all tasks; they pass the driver.
HELD = 250_000
#: Shingles handled at once; keeps the sampling arrays in cache.
BLOCK = 1 << 15
_LEVELS = 1 << 16


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (first row, words per row, word hashes, distinct shingles per row,
    shingles, times)."""
    for first, counts, h in word_hashes(column, ALNUM):
        at = starts_from(counts)
        size = np.minimum(counts, SHINGLE)
        n = np.where(counts > 0, counts - size + 1, 0)
        row = np.repeat(np.arange(len(counts)), n)
        start = at[row] + np.arange(len(row)) - np.repeat(starts_from(n)[:-1], n)
        g = Grams(h).runs(start, size[row]) if len(row) else np.zeros(0, np.uint64)
        order = np.lexsort((g, row))
        g, row = g[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        yield first, counts, h, np.bincount(row[begin], minlength=len(counts)), g[begin], np.diff(np.append(begin, len(g)))


def document_frequencies(docs: DataFrame, bits: int = DF_BITS) -> tuple[int, np.ndarray]:
    """(documents with a shingle, documents per slot).  At most 2 ** bits + 1
    rows leave a task and reach the driver."""
    def run(batches):
        df, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for _, _, _, per_row, g, _ in shingle_sets(batch.column("text")):
                n += int((per_row > 0).sum())
                row = np.repeat(np.arange(len(per_row)), per_row)
                both = np.unique((row << bits) | (g >> np.uint64(64 - bits)).astype(np.int64))
                df += np.bincount(both & ((1 << bits) - 1), minlength=1 << bits)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["slot", "n"])

    got = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots, n = got["slot"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(1 << bits, np.int64)
    df[slots[slots >= 0]] = n[slots >= 0]
    return int(n[slots < 0].sum()), df


def idf_table(n: int, df: np.ndarray) -> np.ndarray:
    return (1 + np.maximum(np.log(max(n, 1) / np.maximum(df, 1)), 0) / np.log(len(df))).astype(np.float32)


def weights_of(g: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    bits = np.uint64(64 - (len(idf).bit_length() - 1))
    return ((1 + np.log(times)) * idf[(g >> bits).astype(np.int64)]).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling.  Per sample and shingle, r and c
    are Gamma(2, 1) and beta is uniform, read from quantile tables by bits of the
    shingle's hash; t = floor(ln w / r + beta), ln a = ln c − r (t + 1 − beta), and
    the shingle with the least ln a is the sample.  ln a depends on the shingle
    and t alone, so equal values mean equal samples."""

    def __init__(self, samples: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.flip = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
        p = (np.arange(_LEVELS) + 0.5) / _LEVELS
        q = np.linspace(0, 24, 1 << 18)
        gamma = np.interp(p, 1 - (1 + q) * np.exp(-q), q)
        self.r, self.log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)

    def signatures(self, per_row: np.ndarray, g: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(rows with a shingle × samples) of float32 sample identities."""
        begin = starts_from(per_row[per_row > 0])
        out = np.empty((len(begin) - 1, len(self.odd)), np.float32)
        log_w = np.log(weight).astype(np.float32)
        row = 0
        while row < len(begin) - 1:
            end = max(int(np.searchsorted(begin, begin[row] + BLOCK, side="right")) - 1, row + 1)
            part = slice(begin[row], begin[end])
            own, lw, cut = g[part], log_w[part], begin[row:end] - begin[row]
            for k in range(len(self.odd)):
                h = mix_light(own ^ self.flip[k], self.odd[k])
                fields = h.view(np.uint16).reshape(-1, 4)
                r = self.r[fields[:, 3]]
                beta = fields[:, 1].astype(np.float32) * np.float32(1 / _LEVELS)
                t = np.floor(lw / r + beta)
                t += 1
                t -= beta
                t *= r
                out[row:end, k] = np.minimum.reduceat(self.log_c[fields[:, 2]] - t, cut)
            row = end
        return out


def mix_light(h: np.ndarray, odd) -> np.ndarray:
    h = h * odd
    return (h ^ (h >> np.uint64(32))) * odd


def held(keys: DataFrame) -> DataFrame:
    """A staged key table as a join side: sent to all tasks up to HELD rows, else shuffled."""
    return F.broadcast(keys) if keys.count() <= HELD else shuffled(keys)


def sketches(docs: DataFrame, idf: np.ndarray, bands: int, rows: int) -> DataFrame:
    """docs(doc_id, text) → doc_id, f1, f2 (128 bits of the word sequence, null
    without a word), bands (array of band keys), mass (sum of the weights)."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(idf)

    def run(batches):
        sampler = Sampler(bands * rows)
        seeds = mix64(np.arange(1, rows + 1, dtype=np.uint64))
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            for first, counts, h, per_row, g, times in shingle_sets(column):
                at, some = starts_from(counts), counts > 0
                whole = Grams(h).runs(at[:-1], counts)
                other = Grams(mix64(h)).runs(at[:-1], counts)
                keys, mass = np.zeros((0, bands), np.int64), np.zeros(len(counts))
                if some.any():
                    weight = weights_of(g, times, table.value)
                    mass[some] = np.add.reduceat(weight, starts_from(per_row[some])[:-1], dtype=np.float64)
                    sig = sampler.signatures(per_row, g, weight).view(np.uint32).astype(np.uint64)
                    sig = sig.reshape(len(sig), bands, rows)
                    keys = mix64((mix64(sig + seeds) * seeds).sum(axis=2, dtype=np.uint64)).view(np.int64)
                cut = starts_from(np.where(some, bands, 0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(counts)), pa.array(whole.view(np.int64), mask=~some), pa.array(other.view(np.int64), mask=~some),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(keys.reshape(-1))), pa.array(mass)],
                    ["doc_id", "f1", "f2", "bands", "mass"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f1 long, f2 long, bands array<long>, mass double")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """pairs(a, b) → (a, b, similarity) of the pairs at or above the threshold.
    Texts ride with the pairs; a task keeps the shingles of the last ``b`` it saw."""
    table = pairs.sparkSession.sparkContext.broadcast(idf)
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def shingles(text):
        for *_, g, times in shingle_sets(pa.array([text], pa.string())):
            return g, weights_of(g, times, table.value).astype(np.float64)

    def run(batches):
        held, theirs = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            keep, value = [], []
            for i in range(batch.num_rows):
                if b[i] != held:
                    held, theirs = b[i], shingles(text_b[i].as_py())
                g, w = shingles(text_a[i].as_py())
                at = np.minimum(np.searchsorted(theirs[0], g), len(theirs[0]) - 1)
                same = theirs[0][at] == g
                lesser = np.minimum(w[same], theirs[1][at[same]]).sum()
                j = lesser / (w.sum() + theirs[1].sum() - lesser)
                if j >= threshold:
                    keep.append(i)
                    value.append(j)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()),
                                              pa.array(value, pa.float64())], ["a", "b", "similarity"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long, similarity double")


def classes(links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """links(a, b) → (id, label): the lowest id of each connected class.  Every
    round each vertex takes the least label around it and then its label's
    label; rounds end at the fixpoint."""
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "class-edges")
    labels = staged(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "class-labels")
    while True:
        around = (edges.join(shuffled(labels.withColumnRenamed("id", "b")), "b").groupBy("a").agg(F.min("label").alias("near")))
        near = labels.join(shuffled(around), labels["id"] == around["a"]).select("id", "label", F.least("label", "near").alias("near"))
        top = labels.select(F.col("id").alias("near"), F.col("label").alias("above"))
        after = staged(near.join(shuffled(top), "near", "left").select("id", F.least("near", F.coalesce("above", "near")).alias("label"), (F.col("label") != F.least("near", F.coalesce("above", "near"))).alias("moved")), "class-labels")
        moved = after.where("moved").limit(1).count()
        labels = after.select("id", "label")
        if not moved:
            return labels


def _closed(groups: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(id, label) of the linked texts and further links(a, b) → staged
    (id, label) of all texts: links between classes close over the classes' labels."""
    ends = (links.join(shuffled(labels.select(F.col("id").alias("a"), F.col("label").alias("la"))), "a", "left")
            .join(shuffled(labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))), "b", "left")
            .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a != b"))
    joined = classes(staged(ends, "minhash-joined")).select(F.col("id").alias("one"), F.col("label").alias("class"))
    out = (groups.select(F.col("rep").alias("id")).join(shuffled(labels), "id", "left").select("id", F.coalesce("label", "id").alias("one"))
           .join(shuffled(joined), "one", "left").select("id", F.coalesce("class", "one").alias("label")))
    return staged(out, "minhash-labels")


def weighted_shingles(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """texts(doc_id, text) → (id, g, w): the weighted shingles of each text."""
    table = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, _, _, per_row, g, times in shingle_sets(batch.column("text")):
                w = weights_of(g, times, table.value).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[first:first + len(per_row)], per_row)), pa.array(g.view(np.int64)), pa.array(w)], ["id", "g", "w"])

    return texts.select("doc_id", "text").mapInArrow(run, "id long, g long, w double")


def outlines(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """texts(doc_id, text) → (id, mass, low, bits): total and least weight, and
    OUTLINE_BITS bits, each the parity of the shingles that fall on it."""
    table = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, _, _, per_row, g, times in shingle_sets(batch.column("text")):
                some = np.flatnonzero(per_row)
                if not len(some):
                    continue
                w, begin = weights_of(g, times, table.value).astype(np.float64), starts_from(per_row[some])[:-1]
                at = np.repeat(np.arange(len(some)), per_row[some]) * OUTLINE_BITS + (g % np.uint64(OUTLINE_BITS)).astype(np.int64)
                odd = np.bincount(at, minlength=len(some) * OUTLINE_BITS).astype(np.uint8) & 1
                words = np.packbits(odd, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(first + some)), pa.array(np.add.reduceat(w, begin)), pa.array(np.minimum.reduceat(w, begin)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * (OUTLINE_BITS // 64)), pa.array(words))], ["id", "mass", "low", "bits"])

    return texts.select("doc_id", "text").mapInArrow(run, "id long, mass double, low double, bits array<long>")


def prefix_pairs(members: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """members(id, label) → (a, b): all pairs of different labels that may reach
    the threshold, each once.

    Shingles are ordered by their number of texts here, rarest first.  Let X ≤ Y be
    the total weights of a pair at or above t.  Its common weight is at least
    2t / (1 + t) · X and t · Y, so the first common shingle in that order lies
    among the first of x, up to (1 − t) / (1 + t) of X, and among the first of y,
    up to 1 − t of Y.  Members meet by the shingles of those prefixes alone.  The
    weights that the two do not share are at most (1 − t) / (1 + t) · (X + Y): all
    that stands before the first common shingle on either side, and a shingle at
    least for each differing bit of their outlines."""
    here = staged(texts.join(shuffled(members.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi"), "minhash-open")
    tokens = staged(weighted_shingles(here, idf), "minhash-shingles")
    spread = staged(tokens.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "minhash-spread")
    order = Window.partitionBy("id").orderBy("df", "g").rowsBetween(Window.unboundedPreceding, -1)
    outline = staged(outlines(here, idf), "minhash-outlines")
    placed = (tokens.join(shuffled(spread), "g", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("before", F.coalesce(F.sum("w").over(order), F.lit(0.0)))
              .join(shuffled(outline.select("id", "mass")), "id").where(F.col("before") <= F.col("mass") * (1 - threshold) * (1 + 1e-9)))
    # a shingle of one text brings no pair; one of many is dealt over salts
    placed = placed.where("df > 1").select("id", "g", "before", (1 + F.floor(F.col("df") / HOT)).cast("int").alias("salts"))
    rows = staged(placed.join(shuffled(members.select("id", "label").join(shuffled(outline), "id")), "id"), "minhash-prefixes")
    # the members of a hot shingle's largest class need not meet each other
    largest = rows.where("salts > 1").groupBy("g", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    largest = staged(largest, "minhash-largest")
    rows = rows.join(held(largest), "g", "left").withColumn("major", F.coalesce(F.col("label") == F.col("largest"), F.lit(False))).drop("largest")
    near = F.col("before") <= F.col("mass") * (1 - threshold) / (1 + threshold) * (1 + 1e-9)
    x = rows.where(near).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    y = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    smaller = (F.col("x.mass") < F.col("y.mass")) | ((F.col("x.mass") == F.col("y.mass")) & (F.col("x.id") < F.col("y.id")))
    able = (F.col("x.label") != F.col("y.label")) & smaller & (F.col("x.mass") >= F.col("y.mass") * (threshold - 1e-6))
    apart = (F.col("x.mass") + F.col("y.mass")) * ((1 - threshold) / (1 + threshold) * (1 + 1e-6))
    differing = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(OUTLINE_BITS // 64)), F.lit(0))
    close = (F.col("x.before") + F.col("y.before") <= apart) & (differing * F.least("x.low", "y.low") <= apart)
    met = (F.col("x.g") == F.col("y.g")) & (F.col("x.salt") == F.col("y.salt")) & able & close
    pairs = x.where("NOT major").alias("x").join(shuffled(y).alias("y"), met).select("x.id", F.col("y.id").alias("other")).unionByName(
        x.where("major").alias("x").join(shuffled(y.where("NOT major")).alias("y"), met).select("x.id", F.col("y.id").alias("other")))
    return pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text, …) → one row per document: doc_id and class_id,
    the lowest doc_id of its class."""
    prepare(docs.sparkSession)
    n, df = document_frequencies(docs)
    idf = idf_table(n, df)
    known = docs.select("doc_id", "text")
    marked = staged(sketches(known, idf, bands, rows), "minhash-sketches")
    live = marked.where(F.col("f1").isNotNull() & F.col("doc_id").isNotNull())
    # equal word sequences: the lowest id stands for all
    groups = staged(live.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"), F.min("mass").alias("mass")), "minhash-texts")
    keys = staged(groups.select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "key")), "minhash-bands")
    centres = staged(keys.groupBy("band", "key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "minhash-centres")
    met = staged(salted_join(keys, shuffled(centres), ["band", "key"], "id"), "minhash-met")
    ids = staged(met.select(F.col("id").alias("doc_id")).distinct(), "minhash-ids")
    texts = staged(known.join(held(ids), "doc_id", "left_semi"), "minhash-candidates")
    tried = staged(met.where("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct(), "minhash-pairs")
    links = staged(verified(tried, texts, idf, threshold), "minhash-links")
    labels = classes(links)
    # buckets that still hold several classes: pairs of their members by an exact prefix filter
    seen = met.select("band", "key", "id").join(shuffled(labels), "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = seen.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("band", "key")
    members = staged(salted_join(seen, shuffled(several), ["band", "key"], "id").select("id", "label").distinct(), "minhash-members")
    rest = prefix_pairs(members, texts, idf, threshold).join(shuffled(tried), ["a", "b"], "left_anti")
    labels = _closed(groups, labels, staged(verified(staged(rest, "minhash-rest"), texts, idf, threshold), "minhash-last"))
    member = groups.select("f1", "f2", "rep").join(shuffled(labels), F.col("rep") == F.col("id")).select("f1", "f2", F.col("label").alias("class_id"))
    out = marked.select("doc_id", "f1", "f2").join(shuffled(member), ["f1", "f2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the lowest id, all columns kept;
    documents without an id stay."""
    gone = near_duplicates(docs, threshold).where(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias("quarry_gone"))
    return docs.join(shuffled(gone), F.col("doc_id") == F.col("quarry_gone"), "left_anti")
