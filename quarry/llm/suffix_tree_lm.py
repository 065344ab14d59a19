"""LM scoring with a probabilistic suffix tree over words.

A text is the sequence of its words, lower-cased in A-Z, and one end.  P(text) is
the product over its tokens of P(token | longest retained context), where a
context is a run of up to ``WORDS`` preceding words of the text, any words.

Counting, level by level: words first, then (context of k words, next word or
end) for k = 1 … ``WORDS``.  Tasks sum before the shuffle.  A run can occur
``LEAST`` times only if its first and its last k words do, so a task hands on
only those that a bit map of the level before admits; the map has a fixed size
and lets some others pass, which the exact counts then drop.  What occurs less
than ``LEAST`` times after a context leaves its mass to the shorter context.

P(w | c) = (n(c, w) + (PRIOR + rest(c)) · P(w | c without its oldest word)) /
(n(c) + PRIOR), down to the distribution of single words.  A context is retained
if it occurs ``LEAST`` times or more and n(c) times its Kullback-Leibler
divergence from its suffix is ``COST`` bits or more; suffixes of retained
contexts are retained too.  The tree grows with the corpus.  It is staged and never
collected: log P(w | c) − log P(w | suffix) is one value for each counted run and
one for each context, so a score is a sum of values looked up by the hashes of a
document's runs.

Where not even the last word is a retained context, a small tree over symbols
predicts.  Its symbols are the end, the ``SYMBOLS`` − 2 most frequent words and
one symbol for all other words; its contexts of up to ``DEPTH`` symbols are
retained if their share of the corpus times their divergence is above ``GAIN``
bits.  It has at most SYMBOLS + … + SYMBOLS ** DEPTH contexts, which bounds its
broadcast; P(w | other) is the share of w in the other words, by absolute
discounting, the discounted mass going to the one event of an unseen word.

Counts of single tokens and values of runs: those that make up at least a
``HEAVY``-th of all tokens are at most ``HEAVY`` many of each length and are
broadcast; all others are looked up.  Both shuffles, that of the counted pairs and
that of the look-ups, are dealt over ranges of hashes, and a task hands on what it
holds for a range as one row of packed sorted arrays: the pairs of some 2 ** 18
runs, or what some hundred documents (a chunk) ask.  Of the pairs' words the
``COMMON`` most frequent take two bytes, all others their hash.  A range has about
``PART`` tokens, whatever the corpus; it meets its range of the tree, and its sums
go back to the chunk, which must be read alike when a task is run again.

On disk are, besides the table in the making, only those that a later step reads:
shuffle files go with each step, staged tables with their last reader.  The documents
are scored in up to ``SLICES`` slices by id, one after the other, each against the
whole tree, so the look-ups of one slice are on disk at a time.

A level is extended only by contexts that can still be retained, or whose
extensions can: ``extendable`` drops those that, with their count, can not save
``COST`` bits even if the least likely word always followed.

Defined cases: a null text is empty: its one token is the end; without training
documents every count is 0 and the distributions are uniform; null ids are
never held out; repeated rows are documents of their own; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import holdout, prepare, staged
from .tokens import mix64, starts_from, word_hashes

HOLD_MOD, HOLD_REST = 7, 2
SYMBOL_BITS, DEPTH = 7, 2
SYMBOLS = 1 << SYMBOL_BITS
END, OTHER = 0, 1
#: Pseudo-counts that a distribution takes from its suffix.
PRIOR = 16.0
#: Bits per symbol that a context must be worth.
GAIN = 2e-7
#: Taken from each other word's count for unseen words.
DISCOUNT = 0.6
HEAVY = 1 << 22
#: Words of the longest context of the tree over all words.
WORDS = 3
#: Occurrences that a context, and a word after it, must have.
LEAST = 4
#: Bits that a context must save over the corpus.
COST = 64.0
#: Slots of the largest bit maps that tell tasks which runs may count.
MAP_BITS = 27
#: Words that pairs name by a rank of two bytes; rank 0 is any other word.
COMMON = (1 << 16) - 1
#: Slices in which the documents of a large corpus are scored.
SLICES = 4
_STEP = np.uint64(0x9FB21C651E98DF25)


@contextmanager
def cleaned(spark: SparkSession):
    """The shuffle files of each query that ends herein go with it."""
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``staged``; the shuffle files behind it go as soon as it is written."""
    with cleaned(df.sparkSession):
        return staged(df, name)


def dropped(*tables: DataFrame) -> None:
    """Deletes ``written`` tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path, uri = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.java.net.URI
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            at, base = path(uri(folder)), path(ensure_checkpoint_dir(spark))
            fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
            if not at.getParent().equals(fs.makeQualified(base)):
                raise ValueError(f"{folder} is no staged table")
            fs.delete(at, True)


def symbols(h: np.ndarray, counts: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, start of each text) for word hashes and words per text; ``top``
    holds the sorted hashes of the words that have a symbol of their own."""
    rows = len(counts)
    out = np.full(len(h) + rows, END, np.int32)
    begin = starts_from(counts)[:-1] + np.arange(rows)
    if len(h):
        own = np.full(len(h), OTHER, np.int32)
        if len(top):
            at = np.minimum(np.searchsorted(top, h), len(top) - 1)
            own = np.where(top[at] == h, at.astype(np.int32) + 2, own)
        out[np.arange(len(h)) + np.repeat(np.arange(rows), counts)] = own
    return out, begin


def contexts(sym: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The ``DEPTH`` symbols before each position, the nearest in the low bits;
    places before the text are the end symbol."""
    ctx = np.zeros(len(sym), np.int64)
    since = np.arange(len(sym)) - np.repeat(begin, np.diff(np.append(begin, len(sym))))
    for k in range(1, DEPTH + 1):
        back = np.zeros(len(sym), np.int64)
        back[k:] = sym[:-k]
        back[since < k] = 0
        ctx |= back << (SYMBOL_BITS * (k - 1))
    return ctx


class _Counter:
    """Counts of integer codes, merged when the buffer is full."""

    def __init__(self, dtype, room: int = 1 << 21):
        self.codes, self.n = np.zeros(0, dtype), np.zeros(0, np.int64)
        self.parts, self.held, self.room = [], 0, room

    def add(self, codes):
        self.parts.append(codes)
        self.held += len(codes)
        if self.held >= self.room:
            self.merge()

    def merge(self):
        if not self.parts:
            return
        new, n = np.unique(np.concatenate(self.parts), return_counts=True)
        codes, back = np.unique(np.concatenate([self.codes, new]), return_inverse=True)
        self.n = np.bincount(back, np.concatenate([self.n, n]), len(codes)).astype(np.int64)
        self.codes, self.parts, self.held = codes, [], 0


#: Distinct codes that a task holds before it hands them on.
FULL = 1 << 21
#: Runs that a task holds before it sums them; sorting takes a few times their size.
HELD = 1 << 18
#: Tokens for each part of a shuffle of packed keys.
PART = 1 << 20


def _emit(counter: _Counter):
    counter.merge()
    for at in range(0, len(counter.codes), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(counter.codes[part].astype(np.int64, copy=False)), pa.array(counter.n[part])], ["code", "n"])
    counter.codes, counter.n = counter.codes[:0], counter.n[:0]


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(text) → (code, n): words by hash, over all rows."""
    def run(batches):
        words = _Counter(np.int64)
        for batch in batches:
            for _, _, h in word_hashes(batch.column("text")):
                words.add(h.view(np.int64))
                if len(words.codes) >= FULL:
                    yield from _emit(words)
        yield from _emit(words)

    rows = docs.select("text").mapInArrow(run, "code long, n long")
    return written(rows.groupBy("code").agg(F.sum("n").alias("n")), "lm-words")


def context_counts(docs: DataFrame, top: np.ndarray) -> DataFrame:
    """docs(text) → (code, n): context and next symbol, over all rows."""
    def run(batches):
        seen = _Counter(np.int64)
        for batch in batches:
            for _, counts, h in word_hashes(batch.column("text")):
                sym, begin = symbols(h, counts, top)
                seen.add((contexts(sym, begin) << SYMBOL_BITS) | sym)
                if len(seen.codes) >= FULL:
                    yield from _emit(seen)
        yield from _emit(seen)

    rows = docs.select("text").mapInArrow(run, "code long, n long")
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


def runs_of(counts: np.ndarray, h: np.ndarray, longest: int):
    """Yields (length k, key of the run of k words from each start, words left
    from there to the end of its text, that end excluded); starts are all words
    whose text has k words from there on."""
    at = starts_from(counts)
    left = np.repeat(at[1:], counts) - np.arange(len(h))
    key, start = h, np.arange(len(h))
    for k in range(1, longest + 1):
        yield k, start, key, left[start] - k
        go = left[start] > k
        key, start = extended(key[go], h[start[go] + k]), start[go]


def extended(key: np.ndarray, word) -> np.ndarray:
    """Key of a run with one more word; the end is word 0."""
    return mix64(key * _STEP + word)


def slots(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def bit_map(codes: DataFrame, bits: int | None = None) -> np.ndarray:
    """codes(code) → bits of the slots that hold a code, as uint64 words; 16 to 32
    slots a code, up to 2 ** ``MAP_BITS``.  At most 2 ** (bits − 6) rows reach the driver."""
    if bits is None:
        bits = min(max((16 * codes.count()).bit_length(), 10), MAP_BITS)
    slot = F.shiftrightunsigned("code", 64 - bits)
    word = F.shiftright(slot, 6).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(code, {64 - bits}) & 63 as int))")
    with cleaned(codes.sparkSession):
        got = codes.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["word"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)
    return out


def admitted(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = slots(key, len(bits).bit_length() + 5)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0


def _pairs(ctx: np.ndarray, word: np.ndarray, n: np.ndarray):
    """Distinct pairs with their sums, in their order."""
    order = np.lexsort((word, ctx))
    ctx, word = ctx[order], word[order]
    new = np.ones(len(ctx), bool)
    new[1:] = (ctx[1:] != ctx[:-1]) | (word[1:] != word[:-1])
    begin = np.flatnonzero(new)
    return ctx[begin], word[begin], np.add.reduceat(n[order], begin) if len(begin) else n[:0]


def shares(key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: equal ranges of all hashes, in their order."""
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def parts_of(n: int) -> int:
    """Parts in which a table of about ``n`` keys is shuffled, of about ``PART``."""
    return max(1, min(-(-n // PART), 1 << 31))


def narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in as few bytes as the largest takes."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def packed(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The bytes of ``values``, one binary value for each step of ``cut``."""
    values = np.ascontiguousarray(values)
    offsets = (cut * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """All values of a column of packed values."""
    got = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(got) if got else np.zeros(0, kind)


def widened(raw: pa.Scalar, m: int) -> np.ndarray:
    """The ``m`` integers that ``narrow`` packed."""
    return np.frombuffer(raw.as_buffer(), f"u{len(raw.as_buffer()) // m}").astype(np.int64)


def unpacked_narrow(column: pa.ChunkedArray, sizes: np.ndarray) -> np.ndarray:
    got = [widened(x, m) for x, m in zip(column, sizes.tolist(), strict=True)]
    return np.concatenate(got) if got else np.zeros(0, np.int64)


def ranked(words: np.ndarray, common: np.ndarray, cut: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Words → for each step of ``cut`` their ranks from 1 in the sorted ``common``,
    packed, and those not there (rank 0), packed."""
    here, at = _found(common, words)
    far = ~here
    return packed(np.where(here, at + 1, 0).astype(np.uint16), cut), packed(words[far], starts_from(far)[cut])


def named(rank: pa.ChunkedArray, rest: pa.ChunkedArray, common: np.ndarray) -> np.ndarray:
    """The words that ``ranked`` packed."""
    rank = unpacked(rank, "u2")
    out, far = np.empty(len(rank), np.uint64), rank == 0
    out[far], out[~far] = unpacked(rest, "u8"), common[rank[~far].astype(np.int64) - 1]
    return out


PAIRS = "part long, head binary, ctx binary, ctxs long, sizes binary, rank binary, word binary, words long, n binary"


def _packed_pairs(ctx: np.ndarray, word: np.ndarray, n: np.ndarray, parts: int, wide: np.ndarray, heads: np.ndarray, common: np.ndarray):
    """Distinct sorted pairs → one row per part; a context is written once before
    its words.  The words of the contexts ``wide`` are dealt over all parts.
    ``heads`` and ``common`` are the contexts and words that have a rank."""
    part = shares(ctx, parts)
    if len(wide):
        far = wide[np.minimum(np.searchsorted(wide, ctx), len(wide) - 1)] == ctx
        part[far] = shares(extended(ctx[far], word[far]), parts)
        order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
        ctx, word, n, part = ctx[order], word[order], n[order], part[order]
    which, at = np.unique(part, return_index=True)
    cut = np.append(at, len(part))
    new = np.ones(len(ctx), bool)
    new[1:] = ctx[1:] != ctx[:-1]
    new[at] = True
    begin = np.flatnonzero(new)
    step = np.searchsorted(begin, cut)
    return pa.RecordBatch.from_arrays(
        [pa.array(which), *ranked(ctx[begin], heads, step), pa.array(np.diff(step)), packed(narrow(np.diff(np.append(begin, len(ctx)))), step),
         *ranked(word, common, cut), pa.array(np.diff(cut)), packed(narrow(n), cut)], [x.split()[0] for x in PAIRS.split(", ")])


def _summed_pairs(part: pa.Table, heads: np.ndarray, common: np.ndarray) -> pa.Table:
    """The packed pairs of one part → (ctx, word, n), ``LEAST`` or more."""
    ctxs, words = part.column("ctxs").to_numpy(), part.column("words").to_numpy()
    ctx = np.repeat(named(part.column("head"), part.column("ctx"), heads), unpacked_narrow(part.column("sizes"), ctxs))
    word, n = named(part.column("rank"), part.column("word"), common), unpacked_narrow(part.column("n"), words)
    key = extended(ctx, word)
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(n[order], begin) if len(begin) else n
    often = n >= LEAST
    at = order[begin[often]]
    return pa.table([pa.array(ctx[at].view(np.int64)), pa.array(word[at].view(np.int64)), pa.array(n[often])], ["ctx", "word", "n"])


def next_counts(docs: DataFrame, k: int, before: np.ndarray, tails: np.ndarray | None = None, parts: int = 1, wide: np.ndarray = np.zeros(0, np.uint64),
                common: np.ndarray = np.zeros(0, np.uint64)) -> DataFrame:
    """docs(text) → (ctx, word, n): runs of ``k`` words with the word after them,
    or 0 at the end, that ``before`` admits as a context and ``tails``
    (``before``) without the oldest word; ``LEAST`` occurrences or more.  Tasks
    hand on sorted pairs, packed by part; ``wide`` holds the sorted contexts
    that one part should not get alone, ``common`` the sorted words that have a rank."""
    known = docs.sparkSession.sparkContext.broadcast((before, tails, wide))
    heads = common if k == 1 else common[:0]  # a longer context is no word

    def run(batches):
        (bits, ends, wide), held, size = known.value, [], 0

        def merged():
            return _pairs(*(np.concatenate([x[i] for x in held]) for i in range(3)))

        for batch in batches:
            for _, counts, h in word_hashes(batch.column("text")):
                for length, start, key, rest in runs_of(counts, h, k):
                    pass
                if length != k or not len(key):
                    continue
                ok = admitted(bits, key)
                # the last k words of context and next word are the run from the next start
                go = rest > 0
                tail = np.ones(len(key), bool)
                tail[:-1] = (ok if ends is None else admitted(ends, key))[1:]
                tail[-1:] = ~go[-1:]
                word = np.zeros(len(key), np.uint64)
                word[go] = h[start[go] + k]
                take = ok & (tail | ~go)
                held.append((key[take], word[take], np.ones(int(take.sum()), np.int64)))
                size += len(held[-1][0])
                if size >= HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if 2 * size >= HELD:
                        yield _packed_pairs(*held[0], parts, wide, heads, common)
                        held, size = [], 0
        if size:
            yield _packed_pairs(*merged(), parts, wide, heads, common)

    def summed(part: pa.Table) -> pa.Table:
        return _summed_pairs(part, heads, common)

    rows = docs.select("text").mapInArrow(run, PAIRS)
    out = written(rows.groupBy("part").applyInArrow(summed, "ctx long, word long, n long"), "lm-next")
    known.destroy()  # its copies on disk too
    return out


def worth(n, q):
    """The most bits that a context of ``n`` occurrences can save if no word after
    it has a probability below ``q`` without its oldest word: they are most
    if one such word always follows."""
    p = (n + PRIOR * q) / (n + PRIOR)
    return n * (p * F.log2(p / q) + (1 - p) * F.log2(F.lit(PRIOR) / (n + PRIOR)))


def extendable(ctxs: DataFrame, least, cost: float) -> DataFrame:
    """ctxs(ctx, n_ctx, …) without those that can neither be retained nor be the
    suffix of a retained context, as ``worth`` tells; ``least`` is the lowest
    probability of a word counted after the context without its oldest word.
    A word counted after a context of n has LEAST / (n + PRIOR) there or more.
    What is left is closed: so are the suffix and the start of each run."""
    n = F.col("n_ctx").cast("double")
    return ctxs.where(F.greatest(worth(n, least), worth(n, LEAST / (n + PRIOR))) >= cost * (1 - 1e-6))


def keyed_runs(rows: DataFrame, k: int) -> DataFrame:
    """rows(ctx, word, n, n_ctx, up) → with ``gram``, the key of context and word,
    and ``tail``, that of the same without the oldest word."""
    def run(batches):
        for b in batches:
            ctx, word, up = (b.column(x).to_numpy().view(np.uint64) for x in ("ctx", "word", "up"))
            gram, tail = extended(ctx, word), extended(up, word) if k > 1 else word
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("ctx", "n", "n_ctx", "up")), pa.array(gram.view(np.int64)), pa.array(tail.view(np.int64))],
                                             ["ctx", "n", "n_ctx", "up", "gram", "tail"])

    return rows.select("ctx", "word", "n", "n_ctx", "up").mapInArrow(run, "ctx long, n long, n_ctx long, up long, gram long, tail long")


def word_tree(train: DataFrame, words: DataFrame, cost: float = COST) -> DataFrame:
    """words(gram, n, p): single words, and the end as word 0 → staged (code, n,
    value, first): what each run of words adds to the log10 probability of its
    last word as against a shorter context, and as a context to that of any
    word after it; ``first`` marks retained contexts of one word."""
    below = words.where(F.col("n") >= LEAST)
    ctxs = below.where("gram != 0").select(F.col("gram").alias("ctx"), F.col("n").alias("n_ctx"), F.lit(0).cast("long").alias("up"))
    tokens, most, least = words.agg(F.sum("n"), F.max("n"), F.min(F.when(F.col("n") >= LEAST, F.col("p")))).first()
    parts = parts_of(tokens or 0)
    ctxs = extendable(ctxs, F.lit(min(least or 1.0, LEAST / ((most or 0) + PRIOR))), cost)
    with cleaned(words.sparkSession):
        common = below.orderBy(F.desc("n"), "gram").select("gram").limit(COMMON).toArrow()["gram"].to_numpy().view(np.uint64)
    common = np.sort(common)
    levels, spent = [], []
    for k in range(1, WORDS + 1):
        # fewer than 4 · parts contexts have a quarter of a part or more
        wide = ctxs.where(F.col("n_ctx") * (4 * parts) >= (tokens or 0)).select("ctx").toArrow()["ctx"].to_numpy().view(np.uint64)
        seen = next_counts(train, k, bit_map(ctxs.select(F.col("ctx").alias("code"))), bit_map(below.select(F.col("gram").alias("code"))), parts, np.sort(wide), common)
        grams = keyed_runs(seen.join(ctxs, "ctx"), k)
        grams = grams.join(below.select(F.col("gram").alias("tail"), F.col("p").alias("q"), F.col("n").alias("n_tail")), "tail")
        own = Window.partitionBy("ctx")
        rest = F.col("n_ctx") - F.sum("n").over(own) + PRIOR
        out = grams.withColumn("rest", rest).withColumn("unseen", F.greatest(1 - F.sum("q").over(own), F.lit(0.0)))
        out = out.withColumn("p", (F.col("n") + F.col("rest") * F.col("q")) / (F.col("n_ctx") + PRIOR)).withColumn("lam", F.col("rest") / (F.col("n_ctx") + PRIOR))
        bits = F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))).over(own) + F.col("lam") * F.col("unseen") * F.log2("lam")
        below = written(out.withColumn("keep", F.col("n_ctx") * bits >= cost).select(
            "ctx", "up", "gram", "tail", "n", "n_tail", "n_ctx", "p", "keep", F.log10("lam").alias("lam"), F.log10(F.col("p") / F.col("q")).alias("more")), "lm-level")
        dropped(seen)
        levels.append(below)
        # the end is never a context; a run that ends a text has no key of its own among the runs of words
        ctxs = extendable(below.select(F.col("gram").alias("ctx"), F.col("n").alias("n_ctx"), F.col("tail").alias("up"), "n_tail"),
                          LEAST / (F.col("n_tail") + PRIOR), cost).drop("n_tail")
    pieces, longer = [], None
    for k in range(WORDS, 0, -1):
        level = levels[k - 1]
        kept = level.where("keep").select("ctx")
        kept = written((kept if longer is None else kept.unionByName(longer)).distinct(), "lm-kept")
        spent += [level, kept]
        rows = level.join(kept, "ctx", "left_semi")
        heads = rows.groupBy("ctx").agg(F.max("n_ctx").alias("n"), F.max("lam").alias("value"), F.max("up").alias("up"))
        longer = heads.select(F.col("up").alias("ctx"))
        pieces += [rows.select(F.col("gram").alias("code"), "n", (F.col("more") - F.col("lam")).alias("value"), F.lit(False).alias("first")),
                   heads.select(F.col("ctx").alias("code"), "n", "value", F.lit(k == 1).alias("first"))]
    tree = pieces[0]
    for piece in pieces[1:]:
        tree = tree.unionByName(piece)
    out = written(tree.groupBy("code").agg(F.max("n").alias("n"), F.sum("value").alias("value"), F.max("first").alias("first")), "lm-tree")
    dropped(*spent)
    return out


def grow_tree(codes: np.ndarray, n: np.ndarray, gain: float = GAIN, prior: float = PRIOR) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts of the longest contexts → (retained contexts of each length from
    1, log10 distributions: the root's row first, then theirs in that order)."""
    total = max(int(n.sum()), 1)
    root = (np.bincount(codes & (SYMBOLS - 1), n, SYMBOLS) + 1) / (n.sum() + SYMBOLS)
    levels, tables, pass_ = [np.zeros(1, np.int64)], [root[None, :]], [np.ones(1, bool)]
    for d in range(1, DEPTH + 1):
        key, back = np.unique(codes & ((1 << (SYMBOL_BITS * (d + 1))) - 1), return_inverse=True)
        count = np.bincount(back, n, len(key))
        ctx, row = np.unique(key >> SYMBOL_BITS, return_inverse=True)
        table = np.zeros((len(ctx), SYMBOLS))
        table[row, key & (SYMBOLS - 1)] = count
        mass = table.sum(axis=1, keepdims=True)
        parent = tables[-1][np.searchsorted(levels[-1], ctx & ((1 << (SYMBOL_BITS * (d - 1))) - 1))]
        table = (table + prior * parent) / (mass + prior)
        bits = (table * np.log2(table / parent)).sum(axis=1)
        levels.append(ctx)
        tables.append(table)
        pass_.append(mass[:, 0] / total * bits > gain)
    for d in range(DEPTH, 1, -1):
        up = np.searchsorted(levels[d - 1], levels[d][pass_[d]] & ((1 << (SYMBOL_BITS * (d - 1))) - 1))
        pass_[d - 1][up] = True
    kept = [levels[d][pass_[d]] for d in range(1, DEPTH + 1)]
    rows = np.concatenate([tables[0], *[tables[d][pass_[d]] for d in range(1, DEPTH + 1)]])
    return kept, np.log10(rows).astype(np.float32)


def state_table(kept: list[np.ndarray]) -> np.ndarray:
    """Row of the longest retained suffix for every context of ``DEPTH`` symbols."""
    state, first = np.zeros(1, np.int32), 1
    for d, ctx in enumerate(kept, 1):
        state = np.tile(state, SYMBOLS)
        state[ctx] = np.arange(first, first + len(ctx), dtype=np.int32)
        first += len(ctx)
    return state


#: Packed rows by part; a chunk's documents go with them, ``place`` is theirs in it.
ASKED = {"kind": "int", "part": "long", "chunk": "long", "code": "binary", "codes": "long", "row": "binary", "times": "binary", "value": "binary"}
ANSWERED = {"chunk": "long", "row": "binary", "rows": "long", "spelled": "binary", "extra": "binary", "more": "binary"}
TEXT = {"doc_id": "long", "held_out": "boolean", "n_tokens": "long", "hits": "long", "base": "double", "score": "double", "place": "long"}
FOUND = {"more": "long", "extra": "double", "spelled": "double"}
#: Kinds of rows: documents, what a chunk asks of single words and of longer runs, and the tables that answer.
DOCUMENT, WORD, RUN, TREE, COUNT = range(5)
#: What a task asks before it hands it on.
ASK = 1 << 19
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def ddl(*columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for x in columns for c, t in x.items())


def filled(m: int, id_type: pa.DataType, *columns: dict[str, str], **given: pa.Array) -> pa.RecordBatch:
    """``m`` rows of ``columns``; those not given are null."""
    types = {c: id_type if c == "doc_id" else _ARROW[t] for x in columns for c, t in x.items()}
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(m, t) for c, t in types.items()], list(types))


def _asked(kind: int, chunk: int, parts: int, row: np.ndarray, code: np.ndarray, moved: np.ndarray | None = None) -> dict[str, pa.Array]:
    """(row, code), rows ascending for each code → one row per part: distinct
    (code, row), how often and, of words, the sum of ``moved``."""
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    code, row, times = code[at], row[at], np.diff(np.append(at, len(new)))
    which, begin = np.unique(shares(code, parts), return_index=True)
    cut = np.append(begin, len(code))
    m = len(which)
    out = {"kind": pa.array(np.full(m, kind, np.int32)), "part": pa.array(which), "chunk": pa.array(np.full(m, chunk)),
           "code": packed(code, cut), "codes": pa.array(np.diff(cut)), "row": packed(narrow(row), cut), "times": packed(narrow(times), cut)}
    return out if moved is None else out | {"value": packed(np.add.reduceat(moved[order], at), cut)}


def answers(table: DataFrame, kind: int, value: str, parts: int) -> DataFrame:
    """table(code, value[, first]) → packed rows by part, to meet those of ``_asked``."""
    def rows(held):
        b = pa.Table.from_batches(held)
        code = b.column("code").to_numpy().view(np.uint64)
        order = np.argsort(code)
        code = code[order]
        which, begin = np.unique(shares(code, parts), return_index=True)
        cut = np.append(begin, len(code))
        m = len(which)
        first = b.column("first").to_numpy()[order].astype(np.uint8)
        return filled(m, None, ASKED, kind=pa.array(np.full(m, kind, np.int32)), part=pa.array(which), code=packed(code, cut), codes=pa.array(np.diff(cut)),
                      times=packed(first, cut), value=packed(b.column("value").to_numpy()[order], cut))

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    first = F.col("first") if "first" in table.columns else F.lit(False)
    return table.select("code", F.col(value).cast("double").alias("value"), first.alias("first")).mapInArrow(run, ddl(ASKED))


def _table(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (codes, values, firsts) of packed ``answers``."""
    code, value, first = unpacked(rows.column("code"), "u8"), unpacked(rows.column("value"), "f8"), unpacked(rows.column("times"), "u1")
    order = np.argsort(code)
    return code[order], value[order], first[order] != 0


def _found(codes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether, where) each code is among the sorted ``codes``."""
    if not len(codes):
        return np.zeros(len(code), bool), np.zeros(len(code), np.int64)
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    return codes[at] == code, at


def _answered(room: float):
    """One part's ``answers`` and ``_asked`` → per chunk and row the sums found."""
    def run(part: pa.Table) -> pa.Table:
        kinds = part.column("kind").to_numpy()
        codes, values, firsts = _table(part.filter(pa.array(kinds == TREE)))
        words, counts, _ = _table(part.filter(pa.array(kinds == COUNT)))
        out = []
        for x in part.filter(pa.array((kinds == WORD) | (kinds == RUN))).to_batches():
            columns = [x.column(c) for c in ("kind", "chunk", "code", "row", "times", "value")]
            for kind, chunk, code, row, times, moved in zip(*columns, strict=True):
                code = np.frombuffer(code.as_buffer(), np.uint64)
                row, times = widened(row, len(code)), widened(times, len(code))
                here, at = _found(codes, code)
                spelled = np.where(here, times * values[at], 0.0) if len(codes) else np.zeros(len(code))
                more, extra = np.zeros(len(code), np.int64), None
                if kind.as_py() == WORD:
                    if len(codes):
                        spelled += np.where(here & firsts[at], np.frombuffer(moved.as_buffer(), np.float64), 0.0)
                    here, at = _found(words, code)
                    if here.any():
                        n = counts[at[here]]
                        more[here] = times[here]
                        extra = np.zeros(len(code))
                        extra[here] = times[here] * np.log10(n + 1.0)
                        spelled[here] += times[here] * np.log10((n - DISCOUNT) / room)
                some = np.bincount(row, (spelled != 0) | (more != 0))
                rows = np.flatnonzero(some)
                if not len(rows):
                    continue
                sums = [np.bincount(row, y)[rows].tobytes() if y is not None else None for y in (spelled, extra)]
                out.append((chunk.as_py(), narrow(np.diff(rows, prepend=0)).tobytes(), len(rows), sums[0], sums[1],
                            narrow(np.bincount(row, more)[rows].astype(np.int64)).tobytes() if extra is not None else None))
        kind = part.schema.field("doc_id").type
        columns = {c: pa.array(x, _ARROW[t]) for (c, t), x in zip(ANSWERED.items(), zip(*out, strict=True) if out else [()] * len(ANSWERED), strict=True)}
        texts = part.filter(pa.array(kinds == DOCUMENT)).combine_chunks()
        given = {c: pa.chunked_array(texts.column(c)).combine_chunks() if texts.num_rows else pa.nulls(0, texts.schema.field(c).type) for c in ("chunk", *TEXT)}
        return pa.Table.from_batches([filled(len(out), kind, ANSWERED, TEXT, **columns), filled(texts.num_rows, kind, ANSWERED, TEXT, **given)])

    return run


def _finished(chunk: pa.Table) -> pa.Table:
    """A chunk's documents with the sums of what was found for them."""
    texts = chunk.filter(pc.is_valid(chunk.column("place")))
    found = chunk.filter(pc.is_null(chunk.column("place"))).select(list(ANSWERED)).to_pylist()
    m = texts.num_rows
    sums = {"more": np.zeros(m, np.int64), "extra": np.zeros(m), "spelled": np.zeros(m)}
    for x in found:
        rows = np.cumsum(np.frombuffer(x["row"], f"u{len(x['row']) // x['rows']}").astype(np.int64))
        sums["spelled"][rows] += np.frombuffer(x["spelled"], np.float64)
        if x["more"] is not None:
            sums["extra"][rows] += np.frombuffer(x["extra"], np.float64)
            sums["more"][rows] += np.frombuffer(x["more"], f"u{len(x['more']) // x['rows']}").astype(np.int64)
    texts, place = texts.select(list(TEXT)), texts.column("place").to_numpy()
    for c in FOUND:
        texts = texts.append_column(c, pa.array(sums[c][place]))
    return texts


def lm_scores(docs: DataFrame, gain: float = GAIN, heavy: int = HEAVY, cost: float = COST) -> DataFrame:
    """docs(doc_id, text, …) → one row per document: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    held = holdout(F.col("doc_id"), HOLD_MOD, HOLD_REST)
    train = docs.where(~held)
    counts = word_counts(train)
    texts = train.count()
    words, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = words + texts, vocabulary + (1 if texts else 0)
    first = counts.orderBy(F.desc("n"), "code").limit(SYMBOLS - 2).collect()
    top = np.sort(np.array([r["code"] for r in first], np.int64).view(np.uint64))
    # at most SYMBOLS ** (DEPTH + 1) rows by construction
    with cleaned(spark):
        seen = context_counts(train, top).toArrow()
    kept, rows = grow_tree(seen["code"].to_numpy(), seen["n"].to_numpy(), gain)
    other, other_types = words - sum(r["n"] for r in first), vocabulary - len(first)
    room = max(other, 1)
    unseen = math.log10(max(DISCOUNT * other_types, DISCOUNT) / room)
    root = 10.0 ** rows[0].astype(np.float64)
    own = [(0, texts, float(root[END])), *((int(c), None, float(root[k + 2])) for k, c in enumerate(top.view(np.int64)))]
    own = spark.createDataFrame(own, "code long, texts long, own double")
    single = counts.select("code", "n").unionByName(own.where("code = 0").select("code", F.col("texts").alias("n")))
    single = single.join(F.broadcast(own.select("code", "own")), "code", "left").select(
        F.col("code").alias("gram"), "n", F.coalesce("own", F.lit(float(root[OTHER])) * (F.col("n") - DISCOUNT) / F.lit(float(room))).alias("p"))
    tree = word_tree(train, single, cost)
    common = counts.where((F.col("n") * heavy >= total) | F.col("code").isin([r["code"] for r in first])).select("code", "n").toArrow()
    hashes = common["code"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], common["n"].to_numpy()[order].astype(np.float64)
    spelled = np.where(np.isin(hashes, top), 0.0, np.log10((n - DISCOUNT) / room))
    # at most heavy runs of each length, and the contexts of the most frequent words
    often = tree.where((F.col("n") * heavy >= total) | F.col("code").isin([r["code"] for r in first])).select("code", "value", "first").toArrow()
    codes = often["code"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    # a run of two maps is admitted by both
    maps = bit_map(tree), bit_map(tree.select(F.shiftleft("code", MAP_BITS).alias("code")))
    runs = (maps, codes[order], often["value"].to_numpy()[order], often["first"].to_numpy()[order])
    model = spark.sparkContext.broadcast((kept, rows, top, hashes, np.log10(n + 1.0), spelled, runs))
    parts = parts_of(words)

    def run(batches):
        kept, rows, top, known, logs, spelled, (maps, codes, values, firsts) = model.value
        state = state_table(kept)
        task, chunks = TaskContext.get().partitionId(), 0
        texts, single, longer, m, size = [], [], [], 0, 0

        def handed():
            chunk = (task << 33) + chunks
            doc_id, held_out, *numbers = (pa.concat_arrays([x[i] for x in texts]) for i in range(6))
            yield filled(m, doc_id.type, ASKED, TEXT, kind=pa.array(np.full(m, DOCUMENT, np.int32)), part=pa.array(np.arange(m) % parts), chunk=pa.array(np.full(m, chunk)),
                         doc_id=doc_id, held_out=held_out, place=pa.array(np.arange(m)), **dict(zip(("n_tokens", "hits", "base", "score"), numbers, strict=True)))
            for kind, asked in ((WORD, single), (RUN, longer)):
                asked = _asked(kind, chunk, parts, *(np.concatenate(x) for x in zip(*asked, strict=True)))
                yield filled(len(asked["part"]), doc_id.type, ASKED, TEXT, **asked)

        for batch in batches:
            for first, per_row, h in word_hashes(batch.column("text")):
                here = len(per_row)
                sym, begin = symbols(h, per_row, top)
                token = rows[state[contexts(sym, begin)], sym]
                score = np.add.reduceat(token, begin, dtype=np.float64)
                row = np.repeat(np.arange(here), per_row)
                uniq, back = np.unique(h, return_inverse=True)
                found, at = _found(known, uniq)
                value = np.where(found, logs[at], 0) if len(known) else np.zeros(len(uniq))
                hits = np.bincount(row, found[back], here).astype(np.int64)
                base = np.bincount(row, value[back], here).astype(np.float64)  # integers if there is no word
                if len(known):
                    score += np.bincount(row, np.where(found, spelled[at], 0)[back], here)
                # after a retained context the root's symbol stands in for the symbol tree's
                moved = (rows[0, sym] - token).astype(np.float64)[np.arange(len(h)) + row + 1]
                often, at = _found(codes, uniq)
                if often.any():
                    score += np.bincount(row, np.where(often, values[at], 0.0)[back] + np.where((often & firsts[at])[back], moved, 0.0), here)
                # a word of the broadcast counts has its context among the broadcast runs, if it is one
                miss = ~found[back]
                word, off = h[miss], moved[miss]
                for bits, shift in zip(maps, (0, MAP_BITS), strict=True):
                    off[~admitted(bits, word << np.uint64(shift))] = 0  # not in the tree: zeros pack well
                single.append((row[miss] + m, word, off))
                late = []
                for k, start, key, rest in runs_of(per_row, h, WORDS + 1):
                    ends = start[rest == 0]
                    over = extended(key[rest == 0], np.uint64(0))
                    if k == 1:
                        start, key = ends, over
                    elif k <= WORDS:
                        start, key = np.concatenate([start, ends]), np.concatenate([key, over])
                    for bits, shift in zip(maps, (0, MAP_BITS), strict=True):
                        ok = admitted(bits, key << np.uint64(shift))
                        start, key = start[ok], key[ok]
                    r = row[start]
                    often, at = _found(codes, key)
                    if often.any():
                        score += np.bincount(r[often], values[at[often]], here)
                    late.append((r[~often], key[~often]))
                # rows ascend for each code, as all runs of a length come together
                longer += [(r + m, key) for r, key in late]
                size += len(single[-1][0]) + sum(len(key) for _, key in late)
                part = batch.slice(first, here)
                texts.append((part.column("doc_id"), part.column("held_out"), *map(pa.array, (per_row + 1, hits, base, score))))
                m += here
                if size >= ASK:
                    yield from handed()
                    texts, single, longer, m, size, chunks = [], [], [], 0, 0, chunks + 1
        if m:
            yield from handed()

    text = TEXT | {"doc_id": dict(docs.dtypes)["doc_id"]}
    tables = written(answers(tree, TREE, "value", parts).unionByName(answers(counts, COUNT, "n", parts)), "lm-answers")
    dropped(tree, counts)
    floor = math.log10(total + distinct + 1)
    end = math.log10(texts + 1)
    unknown = F.col("n_tokens") - 1 - F.col("hits") - F.col("more")
    slices, out = min(SLICES, parts), None
    for k in range(slices):
        own = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == k)
        asked = own.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, ddl(ASKED, text)).unionByName(tables, allowMissingColumns=True)
        answered = asked.groupBy("part").applyInArrow(_answered(float(room)), ddl(ANSWERED, text))
        scored = answered.groupBy("chunk").applyInArrow(_finished, ddl(text, FOUND))
        scored = written(scored.select(
            "doc_id", "held_out", "n_tokens", (F.col("hits") + F.col("more") + F.lit(1 if texts else 0)).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + F.col("extra") + F.lit(end) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
            (F.col("score") + F.col("spelled") + unknown * F.lit(unseen)).alias("score")), "lm-scores")
        out = scored if out is None else out.unionByName(scored)
    dropped(tables)
    model.destroy()
    return out
