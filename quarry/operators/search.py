"""Retrieval operators: exact and approximate vector top-k, trigram similarity,
trigram-accelerated substring search, BM25, reciprocal-rank fusion, tenant
scoping, lineage and context expansion.

Scale rules applied throughout:
* text search reads inverted indexes (``text_index``): only the postings of the
  queries' own trigrams or terms are opened, and queries stay Spark tables;
* vector queries stream past shards of the corpus inside Spark; a shard emits
  only its own top-k per query, so output is k × shards rows per query, not pairs;
* top-k per query is taken in two levels (salted, then global), so a query
  that matches a third of the corpus still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .store import write_staged
from .text_index import TermIndex, TrigramIndex, build_term_index, build_trigram_index, containing, similar, weighted, words

TOPK_SALTS = 32


# ------------------------------------------------------------------ top-k

def top_k(df: DataFrame, group: str, score: str, tie: str, k: int, salts: int = TOPK_SALTS) -> DataFrame:
    """Best ``k`` rows per ``group`` by ``score`` desc, ``tie`` asc, with rank.

    Two levels: first within (group, hash(tie) mod salts), then per group over
    at most k × salts survivors, so no single task sees a whole hot group."""
    salt = F.pmod(F.xxhash64(F.col(tie)), F.lit(salts))
    w1 = Window.partitionBy(group, "_salt").orderBy(F.col(score).desc(), F.col(tie))
    w2 = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    pre = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
             .filter(F.col("_r1") <= k).drop("_r1", "_salt"))
    return pre.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


# ------------------------------------------------------------- vectors

def _normalize(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


QUERY_BLOCK, CORPUS_BLOCK = 1024, 4096     # rows of a block: 1,024 × 4,096 scores at once
#: Vector components that a shard of the corpus holds, most and least queries of a
#: slice: a query is sent once to each shard that it has to see, a shard once to
#: each slice of the queries.
SHARD_VALUES, SLICE_ROWS, LEAST_SLICE = 1 << 22, 65_536, 4096
#: What single-precision scores of unit vectors may be off by, in units of their length.
SINGLE_ERROR = 2.0 ** -22


def _vector_rows(df: DataFrame, id_col: str, vec_col: str, cell: Column | None) -> DataFrame:
    """(id, v, cell) of the rows that can be scored: an id and a vector without nulls."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), (F.lit(0) if cell is None else cell).cast("int").alias("cell"))
    return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))


def _unit_matrix(vecs: pa.Array) -> np.ndarray:
    return _normalize(vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1))


class _Best:
    """The best ``k`` rows so far of each query of a block, ties by ``rank``: rows are
    passed in single precision against the k-th score and scored in double."""

    def __init__(self, qids: pa.Array, vecs: pa.Array, k: int, exclude_self: bool, rank: np.ndarray):
        self.qids, self.q, self.k, self.rank = qids, _unit_matrix(vecs), k, rank
        self.narrow = self.q.astype(np.float32)
        self.slack = SINGLE_ERROR * (self.q.shape[1] + 8)
        self.names = qids.to_pylist() if exclude_self else None
        self.kth = np.full(len(qids), -np.inf)
        self.found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        self.waiting, self.pending = [], 0

    def see(self, at: np.ndarray, rows: np.ndarray, narrow: np.ndarray, first: int, places: dict | None) -> None:
        """Queries ``at`` meet shard rows ``first`` ..."""
        scores = self.narrow[at] @ narrow.T
        floor = self.kth[at]
        over = self.k + (max((len(places.get(self.names[x], ())) for x in at), default=0) if places is not None else 0)
        if len(rows) > over and np.isneginf(floor).any():
            safe = np.where(np.isnan(scores), -np.inf, scores)
            floor = np.maximum(floor, np.partition(safe, -over, axis=1)[:, -over] - self.slack)
        # a NaN is no score; one below the k-th score is no candidate
        i, j = np.nonzero(scores >= (floor - self.slack)[:, None].astype(np.float32))
        if places is not None and len(i):
            own = [(n, p) for n, x in enumerate(at) for p in places.get(self.names[x], ()) if first <= p < first + len(rows)]
            if own:
                keys = np.array([n * len(rows) + p - first for n, p in own])
                keep = ~np.isin(i * len(rows) + j, keys)
                i, j = i[keep], j[keep]
        exact = np.einsum("ij,ij->i", self.q[at[i]], rows[j])
        self.waiting.append((at[i], j + first, exact))
        self.pending += len(i)
        if self.pending >= 4 * self.k * len(self.qids):
            self.settle()

    def settle(self) -> None:
        a, b, c = (np.concatenate([x, *[w[n] for w in self.waiting]]) for n, x in enumerate(self.found))
        self.waiting, self.pending = [], 0
        keep = np.isfinite(c)
        a, b, c = a[keep], b[keep], c[keep]
        order = np.lexsort((self.rank[b], -c, a))
        a, b, c = a[order], b[order], c[order]
        starts = np.searchsorted(a, np.arange(len(self.qids) + 1))
        full = np.flatnonzero(np.diff(starts) >= self.k)
        self.kth[full] = c[starts[full] + self.k - 1]
        keep = np.arange(len(a)) - starts[a] < self.k
        self.found = [a[keep], b[keep], c[keep]]


def _score_shards(k: int, exclude_self: bool, query_block: int, corpus_block: int):
    """mapInArrow body over (slice, shard) groups, the shard's rows first: they are
    held, the queries stream past them block by block."""
    def matrix(parts):
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    def answer(qids, vecs, cells, rows):
        ids, x, narrow, starts, places, rank = rows
        best = _Best(qids, vecs, k, exclude_self, rank)
        lists = cells.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(qids)), np.diff(cells.offsets.to_numpy()))
        order = np.argsort(lists, kind="stable")
        lists, owner = lists[order], owner[order]
        for cell in np.unique(lists):
            if cell not in starts:
                continue
            at = np.unique(owner[np.searchsorted(lists, cell):np.searchsorted(lists, cell, "right")])
            lo, hi = starts[cell]
            for first in range(lo, hi, corpus_block):
                last = min(first + corpus_block, hi)
                best.see(at, x[first:last], narrow[first:last], first, places)
                if first == lo and hi - lo > corpus_block:
                    best.settle()
        best.settle()
        a, b, c = best.found
        return pa.RecordBatch.from_arrays([qids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(c)], ["query_id", "id", "score"])

    def hold(ids, vecs, cells):
        """Rows of a shard by vector length, in the order of their cells."""
        held, dims = {}, np.diff(vecs.offsets.to_numpy())
        for width in np.unique(dims):
            at = np.flatnonzero(dims == width)
            at = at[np.argsort(cells[at], kind="stable")]
            x, own = _unit_matrix(vecs.take(pa.array(at))), cells[at]
            names, places = ids.take(pa.array(at)), None
            if exclude_self:
                places = {}
                for n, name in enumerate(names.to_pylist()):
                    places.setdefault(name, []).append(n)
            cuts = np.flatnonzero(np.diff(own)) + 1
            starts = {own[lo]: (lo, hi) for lo, hi in zip([0, *cuts], [*cuts, len(own)])}
            kind = names.type
            order = pc.sort_indices(names.cast(pa.binary()) if pa.types.is_string(kind) or pa.types.is_large_string(kind) else names).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            held[width] = names, x, x.astype(np.float32), starts, places, rank
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for rb in batches:
            slices, shards, asks = (rb.column(n).to_numpy(zero_copy_only=False) for n in ("slice", "shard", "asks"))
            cuts = np.flatnonzero((np.diff(slices) != 0) | (np.diff(shards) != 0) | (np.diff(asks) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, rb.num_rows]):
                if hi == lo:
                    continue
                if (slices[lo], shards[lo]) != at:
                    at, parts, held = (slices[lo], shards[lo]), [], None
                piece = rb.slice(lo, hi - lo)
                if not asks[lo]:
                    parts.append(piece)
                    continue
                if not parts and held is None:
                    continue
                if held is None:
                    cells = matrix([p.column("cells") for p in parts])
                    held, parts = hold(matrix([p.column("id") for p in parts]), matrix([p.column("v") for p in parts]), cells.flatten().to_numpy(zero_copy_only=False)), []
                for first in range(0, piece.num_rows, query_block):
                    some = piece.slice(first, query_block)
                    dims = np.diff(some.column("v").offsets.to_numpy())
                    for width in np.unique(dims):
                        if width not in held:
                            continue
                        own = some.take(pa.array(np.flatnonzero(dims == width)))
                        out = answer(own.column("qid"), own.column("v"), own.column("cells"), held[width])
                        if out.num_rows:
                            yield out
    return run


def _shards(rows: DataFrame, values: int) -> DataFrame:
    """(cell, dim, blocks, block, shard): cells, those with more than a shard's
    ``values`` vector components cut into blocks, filled into shards of that size."""
    n = rows.groupBy("cell", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * F.col("dim") / F.lit(float(values))
    units = n.withColumn("blocks", F.greatest(F.ceil(share), F.lit(1)).cast("int")).withColumn("share", share)
    units = units.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # one small row per cell or shard
    before = F.sum(F.col("share") / F.col("blocks")).over(Window.orderBy("dim", "cell", "block").rowsBetween(Window.unboundedPreceding, -1))
    return units.select("cell", "dim", "blocks", "block", F.floor(F.coalesce(before, F.lit(0.0))).cast("int").alias("shard"))


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
                 qid_col: str = "query_id", qvec_col: str = "embedding", exclude_self: bool = False,
                 cell: Column | None = None, probes: DataFrame | None = None, query_block: int = QUERY_BLOCK,
                 corpus_block: int = CORPUS_BLOCK, shard_values: int = SHARD_VALUES) -> DataFrame:
    """Cosine top-k of every query over the corpus: (query_id, id, score, rank).

    The corpus is dealt into shards, the queries into slices; a task holds one
    shard and the queries of a slice stream past it, so that a query gives at most
    its top-k per shard and nothing passes the driver but the cells' shards.  With ``cell`` (of a corpus row) and ``probes(id, v, cells)`` a query
    meets the rows of its probed cells only, and is sent once to each shard that
    holds some.  Ids may be of any type; rows with null ids or vectors are not
    scored; a query meets the vectors of its own length."""
    spark = corpus.sparkSession
    sides = _vector_rows(corpus, id_col, vec_col, cell)
    asked = _vector_rows(queries, qid_col, qvec_col, None).select("id", "v", F.array("cell").alias("cells")) if probes is None else probes.select("id", "v", "cells")
    units = write_staged(_shards(sides, shard_values), "vector-shards")
    here = {}
    for r in units.select("dim", "cell", "shard").distinct().collect():  # one small row per cell or shard
        here.setdefault((r.dim, r.cell), []).append(r.shard)
    places = spark.sparkContext.broadcast(here)
    shards, n = max(1, len({s for at in here.values() for s in at})), asked.count()
    slices = max(1, -(-n // SLICE_ROWS), min(-(-n // LEAST_SLICE), -(-2 * spark.sparkContext.defaultParallelism // shards)))

    def send(batches):
        """Each query once to every shard that holds one of its cells."""
        for batch in batches:
            vecs, cells = batch.column("v"), batch.column("cells")
            dims, counts = np.diff(vecs.offsets.to_numpy()), np.diff(cells.offsets.to_numpy())
            flat, first = cells.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])
            at, shard, lists = [], [], []
            for i, dim in enumerate(dims.tolist()):
                to = {}
                for c in flat[first[i]:first[i + 1]].tolist():
                    for s in places.value.get((dim, c), ()):
                        to.setdefault(s, []).append(c)
                for s, own in to.items():
                    at.append(i)
                    shard.append(s)
                    lists.append(own)
            if at:
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), vecs.take(take), pa.array(lists, pa.list_(pa.int32())), pa.array(shard, pa.int32())], ["qid", "v", "cells", "shard"])

    kinds = [dict(d.dtypes)[c] for d, c in (((queries, qid_col) if probes is None else (probes, "id")), (corpus, id_col))]
    sent = asked.mapInArrow(send, f"qid {kinds[0]}, v array<double>, cells array<int>, shard int")
    sent = sent.select(F.pmod(F.xxhash64("qid"), F.lit(slices)).cast("int").alias("slice"), "shard", F.lit(True).alias("asks"), "qid", F.lit(None).cast(kinds[1]).alias("id"), "v", "cells")
    dealt = sides.withColumn("dim", F.size("v")).join(F.broadcast(units.select("cell", "dim", "blocks").distinct()), ["cell", "dim"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(F.broadcast(units.drop("blocks")), ["cell", "dim", "block"])
    dealt = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "shard", F.lit(False).alias("asks"), F.lit(None).cast(kinds[0]).alias("qid"), "id", "v", F.array("cell").alias("cells"))
    met = dealt.unionByName(sent).repartition(slices * shards, "slice", "shard").sortWithinPartitions("slice", "shard", "asks")
    out = met.mapInArrow(_score_shards(k, exclude_self, query_block, corpus_block), f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return top_k(out, "query_id", "score", "id", k)


#: Rows that the cells are fitted on (or FIT_PER_CELL for each cell, if more), queries that the recall is measured on.
FIT_ROWS, FIT_PER_CELL, RECALL_ROWS = 20_000, 32, 64


def cell_centres(rows: DataFrame, n: int, n_cells: int, seed: int = 7) -> np.ndarray:
    """Normalized centres of ``n_cells`` k-means cells (MLlib) of rows(id, v),
    fitted on a sample that grows with the number of cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    share = min(1.0, max(FIT_ROWS, FIT_PER_CELL * n_cells) / max(n, 1))
    near = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))
    unit = _let(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)), lambda n: F.transform("v", lambda x: F.when(n > 0, x / n).otherwise(x)))
    model = KMeans(k=n_cells, seed=seed, featuresCol="f", predictionCol="cell", maxIter=20).fit(near.select(array_to_vector(unit).alias("f")))
    return _normalize(np.array(model.clusterCenters(), dtype=np.float64))


def nearest_cells(rows: DataFrame, centres: np.ndarray, m: int) -> DataFrame:
    """rows(id, v) → (id, v, rank, cell): each row's ``m`` nearest cells.  The
    centres (√N vectors) are broadcast once and compared as a matrix."""
    table = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            vecs = batch.column("v")
            dims = np.diff(vecs.offsets.to_numpy())
            keep = np.flatnonzero(dims == table.value.shape[1])
            if not len(keep):
                continue
            flat = vecs.flatten().to_numpy()
            x = _normalize(flat[np.repeat(dims == table.value.shape[1], dims)].reshape(len(keep), -1))
            dots = x @ table.value.T
            cells = np.argsort(-dots, axis=1, kind="stable")[:, :m] if m > 1 else dots.argmax(axis=1)[:, None]
            at = pa.array(np.repeat(keep, cells.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), vecs.take(at), pa.array(np.tile(np.arange(cells.shape[1], dtype=np.int32), len(keep))),
                                              pa.array(cells.reshape(-1).astype(np.int32))], ["id", "v", "rank", "cell"])

    return rows.select("id", "v").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, v array<double>, rank int, cell int")


def probed_cells(rows: DataFrame, centres: np.ndarray, m: int) -> DataFrame:
    """rows(id, v) → (id, v, cells): each row once, with its ``m`` nearest cells."""
    table = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            vecs = batch.column("v")
            keep = np.flatnonzero(np.diff(vecs.offsets.to_numpy()) == table.value.shape[1])
            for first in range(0, len(keep), QUERY_BLOCK):
                some = batch.take(pa.array(keep[first:first + QUERY_BLOCK]))
                dots = _unit_matrix(some.column("v")) @ table.value.T
                cells = np.argsort(-dots, axis=1, kind="stable")[:, :m].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.reshape(-1)))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("v"), lists], ["id", "v", "cells"])

    return rows.select("id", "v").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, v array<double>, cells array<int>")


def ivf_top_k(corpus: DataFrame, queries: DataFrame, k: int, n_cells: int | None = None, n_probe: int | None = None,
              id_col: str = "id", vec_col: str = "embedding", qid_col: str = "query_id",
              qvec_col: str = "embedding", exclude_self: bool = False, target_recall: float = 0.95) -> DataFrame:
    """Approximate top-k over k-means cells, √N of them unless ``n_cells`` is
    given: every row lies in the blocks of its nearest cell, a query is joined to
    those of its ``n_probe`` nearest cells and no other block is read.  Without
    ``n_probe`` it is the least number whose recall against the exact search, on
    RECALL_ROWS of the queries, reaches ``target_recall``.  Vectors of another
    length than the corpus's commonest are not indexed."""
    cells, asked, n_probe, centres = ivf_plan(corpus, queries, k, n_cells, n_probe, id_col, vec_col, qid_col, qvec_col, exclude_self, target_recall)
    probes = probed_cells(asked, centres, n_probe)
    return cosine_top_k(cells, probes, k, "id", "v", "id", "v", exclude_self, F.col("cell"), probes)


def ivf_plan(corpus, queries, k, n_cells, n_probe, id_col, vec_col, qid_col, qvec_col, exclude_self, target_recall):
    """(corpus rows with their cells, queries, cells to probe, centres)."""
    whole = _vector_rows(corpus, id_col, vec_col, None).select("id", "v")
    asked = _vector_rows(queries, qid_col, qvec_col, None).select("id", "v")
    common = whole.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "dim")).alias("m")).first()["m"]
    n, dim = (common["n"], common["dim"]) if common else (0, 0)
    whole, asked = (x.filter(F.size("v") == dim) for x in (whole, asked))
    n_cells = max(1, min(n, n_cells or int(np.ceil(np.sqrt(n)))))
    centres = cell_centres(whole, n, n_cells) if n else np.zeros((1, max(dim, 1)))
    cells = nearest_cells(whole, centres, 1).select("id", "v", "cell")
    if n_probe is None:
        some = asked.orderBy(F.xxhash64("id"), "id").limit(RECALL_ROWS)
        exact = cosine_top_k(whole, some, k, "id", "v", "id", "v", exclude_self).select("query_id", "id")
        # the rank of the cell in which each true neighbour lies, by query: one small histogram
        ranks = nearest_cells(some, centres, len(centres)).select(F.col("id").alias("query_id"), "rank", "cell")
        where = exact.join(cells.select("id", "cell"), "id").join(ranks, ["query_id", "cell"])
        hist = dict(where.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect())
        total, found, n_probe = sum(hist.values()), 0, 0
        while n_probe < len(centres) and found < target_recall * total:
            found += hist.get(n_probe, 0)
            n_probe += 1
    return cells, asked, max(n_probe, 1), centres


# ------------------------------------------------------------------- text

def trigram_search(chunks: DataFrame, queries: DataFrame, k: int, threshold: float,
                   id_col: str = "sha256", text_col: str = "markdown", qid_col: str = "query_id",
                   qtext_col: str = "text", index: TrigramIndex | None = None) -> DataFrame:
    """Top-k chunks per query by trigram set similarity |A∩B| / |A∪B| with
    similarity ≥ threshold (> 0), exact, ties by chunk id: (query_id, id,
    similarity, rank).  Only the postings of the queries' trigrams are read."""
    index = index or build_trigram_index(chunks, id_col, text_col)
    kinds = queries.schema[qid_col].dataType, index.id_type
    hits = similar(index, queries, k, threshold, qid_col, qtext_col).select(
        F.col("q").cast(kinds[0]).alias(qid_col), F.col("id").cast(kinds[1]).alias(id_col), "similarity")
    return top_k(hits, qid_col, "similarity", id_col, k)


def substring_search(chunks: DataFrame, patterns: DataFrame, id_col: str = "sha256", text_col: str = "markdown",
                     pid_col: str = "pattern_id", pat_col: str = "pattern", index: TrigramIndex | None = None) -> DataFrame:
    """(pattern, chunk) for every chunk containing a pattern (case-sensitive,
    exact), candidates from the trigram index.  Empty and null patterns find
    nothing."""
    index = index or build_trigram_index(chunks, id_col, text_col)
    return containing(index, patterns, pid_col, pat_col).select(F.col("p").alias(pid_col), F.col("id").alias(id_col))


def regex_search(chunks: DataFrame, patterns: DataFrame, id_col: str = "sha256", text_col: str = "markdown",
                 pid_col: str = "pattern_id", pat_col: str = "pattern", index: TrigramIndex | None = None) -> DataFrame:
    """(pattern, chunk) for every chunk that a regular expression matches
    somewhere; the trigrams of the literal runs that it needs narrow the chunks."""
    index = index or build_trigram_index(chunks, id_col, text_col)
    return containing(index, patterns, pid_col, pat_col, regex=True).select(F.col("p").alias(pid_col), F.col("id").alias(id_col))


def bm25(chunks: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75,
         id_col: str = "sha256", text_col: str = "markdown", qid_col: str = "query_id",
         qtext_col: str = "text", index: TermIndex | None = None) -> DataFrame:
    """Okapi BM25 top-k per query over word tokens: (query_id, id, score, rank)."""
    index = index or build_term_index(chunks, id_col, text_col)
    kinds = queries.schema[qid_col].dataType, index.id_type
    scores = weighted(index, queries, k, qid_col, qtext_col, k1, b).select(F.col("q").cast(kinds[0]).alias(qid_col), F.col("id").cast(kinds[1]).alias(id_col), "score")
    return top_k(scores, qid_col, "score", id_col, k)


def rrf(*ranked: DataFrame, qid_col: str = "query_id", id_col: str = "sha256", c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, id, rank)."""
    parts = [r.select(qid_col, id_col, (F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("s")) for r in ranked]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(qid_col, id_col).agg(F.sum("s").alias("score"))


# ------------------------------------------------------------ hashing embedder

def hash_embed(text: Column, dim: int = 64) -> Column:
    """Deterministic bag-of-words embedding (the default embedder hook): each
    lower-cased word adds one to bucket md5(word)[:8] mod dim; L2-normalized, all
    zeros without a word.  Column functions only."""
    buckets = F.transform(words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int"))

    def counts(b):
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(b) - F.size(F.array_remove(b, i))).cast("double"))

    def unit(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return _let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))
    return F.when(text.isNotNull(), _let(buckets, lambda b: _let(counts(b), unit)))


def _let(value: Column, body) -> Column:
    """Bind ``value`` so that ``body`` may use it many times."""
    return F.transform(F.array(value), body)[0]


# -------------------------------------------------------- scope & context

def in_scope(source: Column, allowed: list[str]) -> Column:
    """Tenant filter: source equals an allowed prefix or lies beneath it."""
    cond = F.lit(False)
    for p in allowed:
        cond = cond | (source == p) | source.startswith(p + "/")
    return cond


def scoped_chunks(file_chunks: DataFrame, sources: DataFrame, allowed: list[str]) -> DataFrame:
    """Chunk rows whose file is held by at least one allowed source (semi join)."""
    ok = sources.filter(in_scope(F.col("source"), allowed)).select("file_sha256")
    return file_chunks.join(ok, "file_sha256", "left_semi")


def lookup(sources: DataFrame, source: str | None = None, source_id: str | None = None, sha256: str | None = None,
           url: str | None = None, url_files: DataFrame | None = None) -> DataFrame:
    """Source rows that meet all given conditions, in any combination: an exact
    source, its id, the file's hash, or a URL of the file (by ``url_files``).
    Filters reach the scans; chunks are joined to what is left."""
    out = sources
    for name, value in (("source", source), ("source_id", source_id), ("file_sha256", sha256)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    if url is not None:
        held = url_files.filter((F.col("url") == url) | (F.col("resolved_url") == url)).select("file_sha256")
        out = out.join(held, "file_sha256", "left_semi")
    return out


def lineage(file_chunks: DataFrame, sources: DataFrame, approx: bool = False, rsd: float = 0.02) -> DataFrame:
    """Per chunk: files holding it and distinct sources holding those files
    (distinct counts via partial aggregation; no per-chunk lists).  With
    ``approx`` the counts are HyperLogLog++ sketches (relative error ``rsd``),
    which merge map-side and never expand (chunk, value) pairs."""
    fc = file_chunks.select("file_sha256", "chunk_sha256").distinct()
    j = fc.join(sources.select("file_sha256", "source"), "file_sha256", "left")
    if approx:
        return j.groupBy("chunk_sha256").agg(F.approx_count_distinct("file_sha256", rsd).alias("n_files"),
                                             F.approx_count_distinct("source", rsd).alias("n_sources"))
    return j.groupBy("chunk_sha256").agg(F.countDistinct("file_sha256").alias("n_files"),
                                         F.countDistinct("source").alias("n_sources"))


def context_window(hits: DataFrame, file_chunks: DataFrame, k: int) -> DataFrame:
    """Neighbours idx-k..idx+k of each hit chunk in every file holding it;
    overlapping windows merged by distinct (file, idx).  The range join is an
    equi-join on the file plus generated offsets, so no theta join is needed."""
    at = hits.select("chunk_sha256").distinct().join(file_chunks, "chunk_sha256") \
             .select("file_sha256", "idx")
    near = at.select("file_sha256", F.explode(F.sequence(F.col("idx") - k, F.col("idx") + k)).alias("idx")).distinct()
    return near.join(file_chunks, ["file_sha256", "idx"])
