"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features of a text are its distinct words, word pairs and skip-pairs (one word
left out), lower-cased and hashed into ``2 ** BITS`` slots.  The model is
fitted by FTRL-proximal with per-coordinate learning rates; the L1 term keeps
only slots that carry weight, so what is broadcast is a short list of
(slot, weight), at most ``2 ** BITS`` of them.  Scoring is one map over the
documents.

It is fitted on a bounded sample of labelled rows, ``PER_CLASS`` of each class,
drawn by a hash of the id from rows that are not held out.

Defined cases: a null or empty text scores by the intercept alone; null labels
are ignored; a document with several labels counts as toxic if any says so;
with labels of one class or none the score is that class's share (0 without
labels); repeated rows score alike; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holdout, prepare
from .sampling import labelled_sample
from .tokens import ALNUM, mix64, word_hashes

BITS = 18
PER_CLASS = 4000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 1.0
HOLD_MOD, HOLD_REST = 5, 0


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (first row, number of rows, row of each feature, slot of each
    feature); a slot may repeat within a row."""
    shift = np.uint64(64 - bits)
    for first, counts, h in word_hashes(column, ALNUM):
        row = np.repeat(np.arange(len(counts)), counts)
        slots, rows = [mix64(h) >> shift], [row]
        for gap, seed in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
            if len(h) > gap:
                ok = row[gap:] == row[:-gap]
                slots.append((mix64(h[:-gap] * np.uint64(seed) + h[gap:]) >> shift)[ok])
                rows.append(row[gap:][ok])
        yield first, len(counts), np.concatenate(rows), np.concatenate(slots).astype(np.int64)


def _distinct(rows: np.ndarray, slots: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows << bits) | slots)
    return both >> bits, both & ((1 << bits) - 1)


def feature_rows(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs(label, text) → label, slots (binary int32 array of distinct slots)."""
    def run(batches):
        for batch in batches:
            label = batch.column("label")
            for first, n, rows, slots in features(batch.column("text"), bits):
                rows, slots = _distinct(rows, slots, bits)
                cut = np.searchsorted(rows, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [label.slice(first, n), pa.array([slots[cut[i]:cut[i + 1]].astype(np.int32).tobytes() for i in range(n)], pa.binary())],
                    ["label", "slots"])
    return docs.select("label", "text").mapInArrow(run, "label int, slots binary")


def fit_ftrl(examples: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA,
             beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, intercept).  Each coordinate keeps the sum of squared
    gradients, which sets its own rate, and the proximal sum that L1 cuts to 0.
    The last slot of the table is the intercept, which L1 doesn't touch."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    one = 1 << bits

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(z[i]) <= l1] = 0
        if len(i) and i[-1] == one:
            w[-1] = -z[one] / ((beta + np.sqrt(n[one])) / alpha + l2)
        return w

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            y, slots = examples[k]
            i = np.append(slots, one)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(one + 1))
    keep = np.flatnonzero(w[:-1])
    return keep.astype(np.int32), w[keep].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS):
    """Model from the labelled rows that are not held out."""
    marks = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~holdout(F.col("doc_id"), HOLD_MOD, HOLD_REST))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    have = marks.join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = labelled_sample(have, "label", per_class)
    rows = feature_rows(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), bits).toArrow()
    examples = sorted(((y, s) for y, s in zip(rows["label"].to_pylist(), rows["slots"].to_pylist(), strict=True)))
    examples = [(y, np.frombuffer(s, np.int32).astype(np.int64)) for y, s in examples]
    classes = {y for y, _ in examples}
    if len(classes) < 2:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 35.0 if classes == {1} else -35.0
    return fit_ftrl(examples, bits)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS) -> DataFrame:
    """docs(doc_id, text, …), labels(doc_id, toxic, …) → doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, per_class, bits))

    def run(batches):
        slots, weights, intercept = model.value
        table = np.zeros(1 << bits, np.float32)
        table[slots] = weights
        for batch in batches:
            margin = np.full(batch.num_rows, intercept)
            for first, n, rows, found in features(batch.column("text"), bits):
                live = table[found] != 0
                rows, found = _distinct(rows[live], found[live], bits)
                margin[first:first + n] += np.bincount(rows, table[found], n)
            score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                                              pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return (docs.select("doc_id", holdout(F.col("doc_id"), HOLD_MOD, HOLD_REST).alias("held_out"), "text")
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int"))
