"""Language ID by hierarchical discrimination.

The language family is predicted first, then one-versus-one linear support
vector machines tell the languages of that family apart; families are told
apart by one-versus-one machines as well.  Features are the shares of byte
trigrams of the lower-cased letters, hashed into ``BINS`` bins and centred and
scaled on the sample, so a text's margin is a sum over its positions and one
vectorised pass scores whole texts of any length.

The machines are fitted on a bounded sample: ``PER_LANGUAGE`` documents of each
language, drawn by a hash of the id from rows that are not held out.

Defined cases: null texts and texts without a letter get ``und`` with score 0;
null languages are not learned from; with one learned language every other text
gets it; with none every text gets ``und``; repeated rows are predicted alike;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holdout, prepare
from .sampling import labelled_sample
from .tokens import pieces, text_bytes

BIN_BITS = 12
BINS = 1 << BIN_BITS
PER_LANGUAGE = 400
HOLD_MOD, HOLD_REST = 4, 2
UNKNOWN = "und"
#: Below this score a document counts as rejected.
MIN_SCORE = 0.3
#: Steepness of the logistic curve over a margin in units of the training margin.
SLOPE = 3.0

#: Language codes by family; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-iranian": ("bn", "fa", "gu", "hi", "mr", "ne", "pa", "ur"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

# bytes that are not letters become one gap byte: ASCII but a-z
_LETTERS = np.full(256, 0x20, np.uint32)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, f"only {lang}")


def _trigram_bins(data: np.ndarray) -> np.ndarray:
    """Bin of the trigram that starts at each byte (two gap bytes follow the end)."""
    b = np.append(_LETTERS[data], [0x20, 0x20]).astype(np.uint32)
    code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BIN_BITS)).astype(np.int64)


def _shares(data: np.ndarray) -> np.ndarray:
    """Trigram shares of one text; trigrams that start in a gap don't count."""
    got = np.bincount(_trigram_bins(data)[_LETTERS[data] != 0x20], minlength=BINS).astype(np.float32)
    return got / max(got.sum(), 1)


def _fit_machine(x: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int = 30, c: float = 0.01) -> tuple[np.ndarray, float]:
    """Linear SVM for labels ±1 of some rows of ``x`` by averaged stochastic
    subgradient steps on the hinge loss; both classes weigh alike."""
    rng, n = np.random.default_rng(3), len(y)
    weight = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1)))
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b, seen, t = np.zeros_like(w), 0.0, 0, 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 32):
            i = order[at:at + 32]
            t += 1
            rate = 1 / (c * (t + 100))
            miss = y[i] * (x[rows[i]] @ w + b) < 1
            j = i[miss]
            w *= 1 - rate * c
            if len(j):
                g = weight[j] * y[j] / len(i)
                w += rate * (g @ x[rows[j]])
                b += rate * g.sum() * 0.01
            if epoch >= epochs // 2:
                seen += 1
                mean_w += (w - mean_w) / seen
                mean_b += (b - mean_b) / seen
    return mean_w, mean_b


class Model:
    """Pairwise machines as columns of one table: margin = Σ table[bin] / n + bias."""

    def __init__(self, langs, table, bias, pairs):
        self.langs, self.table, self.bias, self.pairs = langs, table, bias, pairs


def fit_model(langs: list[str], x: np.ndarray) -> Model:
    """langs and trigram shares of the sample rows (overwritten) → the fitted hierarchy."""
    known = sorted(set(langs))
    mean, scale = x.mean(axis=0), (1 / (x.std(axis=0) + 1e-3)).astype(np.float32)
    x -= mean
    x *= scale
    families = sorted({family_of(v) for v in known})
    own = np.array(langs)
    kin = np.array([family_of(v) for v in langs])
    pairs = [("family", a, b) for a, b in combinations(families, 2)]
    pairs += [("lang", a, b) for a, b in combinations(known, 2) if family_of(a) == family_of(b)]
    columns, bias = [], []
    for level, a, b in pairs:
        group = kin if level == "family" else own
        i = np.flatnonzero((group == a) | (group == b))
        w, b0 = _fit_machine(x, i, np.where(group[i] == a, 1.0, -1.0))
        columns.append(w * scale)
        bias.append(b0 - (w * scale * mean).sum())
    table = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((x.shape[1], 0), np.float32)
    return Model(known, table, np.array(bias), pairs)


def decide(model: Model, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Margins (rows × machines) → language and score of each row.  Wins are
    counted first, equal wins go to the larger summed margin; the score is the
    product over both levels of the winner's least certain decision."""
    n = len(margins)
    soft = 1 / (1 + np.exp(-np.clip(SLOPE * margins, -35, 35)))

    def level(kind, names):
        wins, sums, least = np.zeros((n, len(names))), np.zeros((n, len(names))), np.ones((n, len(names)))
        at = {v: k for k, v in enumerate(names)}
        for k, (own, a, b) in enumerate(model.pairs):
            if own == kind and a in at and b in at:
                for v, p in ((at[a], soft[:, k]), (at[b], 1 - soft[:, k])):
                    wins[:, v] += p > 0.5
                    sums[:, v] += p
                    least[:, v] = np.minimum(least[:, v], p)
        best = np.argmax(wins + sums / (len(names) + 1), axis=1)
        return best, least[np.arange(n), best]

    families = sorted({family_of(v) for v in model.langs})
    family, sure = level("family", families)
    out, score = np.empty(n, object), sure.copy()
    for k, name in enumerate(families):
        rows = family == k
        names = [v for v in model.langs if family_of(v) == name]
        if rows.any():
            best, s = level("lang", names)
            out[rows] = np.array(names, object)[best[rows]]
            score[rows] *= s[rows]
    return list(out), score


def share_rows(docs: DataFrame) -> DataFrame:
    """docs(lang, text lower-cased) → lang, shares (binary float32)."""
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, 1), pa.array(
                    [_shares(data[offsets[i]:offsets[i + 1]]).tobytes()], pa.binary())], ["lang", "shares"])
    return docs.select("lang", "text").mapInArrow(run, "lang string, shares binary")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}")
                      & ~holdout(F.col("doc_id"), HOLD_MOD, HOLD_REST)).select("doc_id", "lang")
    sample = labelled_sample(rows, "lang", per_language).dropDuplicates(["doc_id"])
    texts = docs.select("doc_id", F.lower("text").alias("text")).join(F.broadcast(sample), "doc_id")
    got = share_rows(texts).toArrow()
    if not got.num_rows:
        return None
    rows = sorted(zip(got["lang"].to_pylist(), got["shares"].to_pylist(), strict=True))
    del got
    x = np.empty((len(rows), BINS), np.float32)
    for k, (_, shares) in enumerate(rows):
        x[k] = np.frombuffer(shares, np.float32)
    langs = [v for v, _ in rows]
    del rows
    return fit_model(langs, x)


def predict_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs(doc_id, text, lang, …) → one row per document: doc_id, held_out, lang_pred, score."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", holdout(F.col("doc_id"), HOLD_MOD, HOLD_REST).alias("held_out"), "text")
    return _predict(docs, rows, f"doc_id {kind}, held_out boolean", per_language)


def identified_documents(docs: DataFrame, per_language: int = PER_LANGUAGE, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is recognised, all columns kept."""
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = _predict(docs, docs, carried, per_language, ("quarry_lang", "quarry_score"))
    return out.where((F.col("quarry_lang") != UNKNOWN) & (F.col("quarry_score") >= min_score)).drop("quarry_lang", "quarry_score")


def _predict(docs: DataFrame, rows: DataFrame, carried: str, per_language: int, names=("lang_pred", "score")) -> DataFrame:
    """Adds language and score to ``rows``; a text column among the carried ones
    stays as it is, another one is dropped after its use."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(fit(docs, per_language))
    keep = [f.strip("`") for f in rows.columns if f != "text" or "`text`" in carried]
    plain = F.coalesce("text", F.lit(""))
    sent = rows.withColumn("quarry_lower", F.when(plain.rlike(r"\p{L}"), F.lower(plain)))

    def run(batches):
        m = model.value
        for batch in batches:
            text = batch.column(batch.schema.names.index("quarry_lower"))
            n = batch.num_rows
            width = 0 if m is None else m.table.shape[1]
            margins = np.zeros((n, width))
            if width:
                data, offsets = text_bytes(text)
                for a, b in pieces(offsets):
                    part = data[offsets[a]:offsets[b]]
                    local = offsets[a:b + 1] - offsets[a]
                    bins, live = _trigram_bins(part), _LETTERS[part] != 0x20
                    # a trigram may not run over the end of its text: its last two places are read as gaps
                    for k in (1, 2):
                        edge = local[1:][np.diff(local) >= k] - k
                        nxt = np.full((len(edge), 3), 0x20, np.uint32)
                        for j in range(k):
                            nxt[:, j] = _LETTERS[part[edge + j]]
                        code = nxt[:, 0] * np.uint32(65536) + nxt[:, 1] * np.uint32(256) + nxt[:, 2]
                        bins[edge] = ((code * np.uint32(2654435761)) >> np.uint32(32 - BIN_BITS)).astype(np.int64)
                    at, bins = np.flatnonzero(live), bins[live]
                    cut = np.searchsorted(at, local)
                    for k in range(width):
                        sums = np.zeros(len(bins) + 1)
                        np.cumsum(m.table[bins, k], out=sums[1:], dtype=np.float64)
                        margins[a:b, k] = (sums[cut[1:]] - sums[cut[:-1]]) / np.maximum(np.diff(cut), 1)
                margins += m.bias
            empty = text.is_null().to_numpy(zero_copy_only=False)
            if m is None:
                langs, score = [UNKNOWN] * n, np.zeros(n)
            else:
                langs, score = decide(m, margins)
            langs = [UNKNOWN if e else v for v, e in zip(langs, empty, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(c)) for c in keep]
                                             + [pa.array(langs, pa.string()), pa.array(np.where(empty, 0.0, score))], [*keep, *names])

    return sent.mapInArrow(run, f"{carried}, {names[0]} string, {names[1]} double")
