"""Approximate nearest neighbours: multiprobe p-stable hashing, exact reranking.

Nearness is the inner product.  Vectors are divided by the greatest norm and get
one more component that makes them unit vectors, a query is divided by its own
norm and gets a zero there: the largest inner product is then the least Euclidean
distance, for which projections on Gaussian (2-stable) directions, shifted and cut
into cells, collide more often the nearer two points are.  ``TABLES`` tables hash
with ``K`` functions each; K follows the number of rows.

A query visits its own bucket and then perturbed ones: a perturbation moves some
of the K cells by one, and the sets are visited by their estimated squared
distance to the boundaries they cross (expected order statistics), mapped to the
query by the order of its own distances.  The number of probes is the least one
that reaches ``TARGET`` recall on a bounded sample; where no number does, all
buckets are visited.  Every row is indexed.

Buckets are dealt over groups of at most ``GROUP_BYTES`` of vectors; a bucket
that outgrows a group is dealt over several by its ids.  A query is sent once to
each group that holds a bucket it visits; the task merges the candidates of all
tables, scores them in blocks and emits its best ``k``, so no pair of query and
candidate is ever a row.  Queries that found fewer than ``k`` visit all buckets.

Equal vectors: ties go to smaller ids, so of each set of copies only the first
k + 1 can be in any answer, and only those are indexed.

Defined cases: vectors null, empty, zero or with null or non-finite components,
and null ids, take no part; candidates of another length are no candidates; of
rows that share an id the least vector counts; a query is never its own
neighbour, its copies under other ids are; an empty table gives no row; extra
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.search import top_k
from .common import let, prepare, small, staged
from .tokens import mix64

NEIGHBOURS = 20
TABLES = 2
#: Cell width in units of the vectors' norm, and rows for which a bucket is made.
WIDTH, PER_BUCKET = 2.0, 128
TARGET, MOST_PROBES = 0.95, 1 << 14
#: Bounds of the sample that sets the number of probes.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_QUERIES = 20_000, 64 << 20, 256
GROUP_BYTES = 128 << 20
#: Scores held at once, in numbers.
BLOCK = 1 << 22
SEED = 13


def usable(embedding: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def norm_of(embedding: Column) -> Column:
    """Euclidean norm, scaled so that squares can't overflow."""
    top = F.greatest(F.abs(F.array_max(embedding)), F.abs(F.array_min(embedding))).cast("double")
    return let(top, lambda m: m * F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda s, x: s + (x / m) * (x / m))))


def probing_sequence(k: int, most: int) -> np.ndarray:
    """Perturbation sets in the order of their estimated distance, each a row of
    indices into the 2k sorted boundary distances, padded with 2k."""
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    far = 1 - j[::-1] / (k + 1) + j[::-1] * (j[::-1] + 1) / (4 * (k + 1) * (k + 2))
    cost, n = np.concatenate([near, far]), 2 * k
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < most:
        total, members = heapq.heappop(heap)
        last = members[-1]
        if last + 1 < n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], members[:-1] + (last + 1,)))
            heapq.heappush(heap, (total + cost[last + 1], members + (last + 1,)))
        if len({min(i, n - 1 - i) for i in members}) == len(members):  # a cell can't move both ways
            out.append(members)
    table = np.full((len(out), max(map(len, out), default=0) or 1), n, np.int64)
    for row, members in enumerate(out):
        table[row, :len(members)] = members
    return table


class Hashing:
    """The hash functions of all tables for vectors of one length."""

    def __init__(self, dim: int, k: int, greatest: float, tables: int = TABLES):
        rng = np.random.default_rng([SEED, dim])
        self.k, self.greatest, self.tables = k, greatest, tables
        self.axes = rng.standard_normal((dim + 1, tables * k))
        self.shift = rng.uniform(0, WIDTH, tables * k)
        self.odd = rng.integers(0, 1 << 63, tables * k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _cells(self, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return (x @ self.axes[:-1] + rest[:, None] * self.axes[-1] + self.shift) / WIDTH

    def _codes(self, cells: np.ndarray) -> np.ndarray:
        parts = np.floor(cells).astype(np.int64).view(np.uint64) * self.odd
        return parts.reshape(len(cells), self.tables, self.k).sum(axis=2, dtype=np.uint64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """(rows × tables) bucket codes of indexed vectors."""
        x = x / self.greatest
        rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        return self._codes(self._cells(x, rest))

    def probes(self, q: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """(tables × probes) bucket codes of one query, in visiting order."""
        q = q / np.abs(q).max()
        cells = self._cells((q / np.sqrt(q @ q))[None], np.zeros(1))
        base, inside = self._codes(cells)[0], (cells - np.floor(cells)).reshape(self.tables, self.k)
        odd = self.odd.reshape(self.tables, self.k)
        out = np.empty((self.tables, len(sequence)), np.uint64)
        for t in range(self.tables):
            order = np.argsort(np.concatenate([inside[t], 1 - inside[t]]), kind="stable")
            step = np.append(np.concatenate([np.uint64(0) - odd[t], odd[t]])[order], np.uint64(0))
            out[t] = base[t] + step[sequence].sum(axis=1, dtype=np.uint64)
        return out


def vectors_of(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """[(length, row numbers, matrix of doubles)] of a list column without nulls."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    out = []
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        out.append((int(dim), rows, values[begin[rows][:, None] + np.arange(dim)]))
    return out


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components,
    so that equal vectors have equal scores wherever they are computed."""
    s = np.zeros(len(x))
    for j in range(len(q)):
        s += x[:, j] * q[j]
    return s


def best(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, rough: np.ndarray, q: np.ndarray, own: int, k: int, copies: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, exact scores) of the k nearest of the candidate ``rows``; their
    ``rough`` scores are right within ``slack``, an id may come ``copies`` times."""
    reach = (k + 1) * copies
    if len(rows) > reach:
        rows = rows[rough >= np.partition(rough, len(rough) - reach)[len(rough) - reach] - slack]
    found, first = np.unique(ids[rows], return_index=True)
    exact = exact_scores(x[rows[first]], q)
    order = np.lexsort((found, -exact))
    order = order[found[order] != own][:k]
    return found[order], exact[order]


class Plan:
    """What the index and its queries share: hash functions by length, probing
    sequence, the groups and the buckets that are dealt over several of them."""

    def __init__(self, k: int, greatest: float, groups: int, tables: int = TABLES):
        self.k, self.greatest, self.groups, self.tables = k, greatest, groups, tables
        self.sequence, self.split, self._made = np.zeros((1, 1), np.int64), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), {}

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    def hashing(self, dim: int) -> Hashing:
        if dim not in self._made:
            self._made[dim] = Hashing(dim, self.k, self.greatest, self.tables)
        return self._made[dim]

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """Bucket keys: codes (… × tables) told apart by their table."""
        return mix64(codes ^ mix64(np.arange(1, self.tables + 1, dtype=np.uint64)))

    def group(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The group of each bucket key, or of the row's part of a split bucket."""
        big, parts = self.split
        if len(big):
            at = np.minimum(np.searchsorted(big, keys), len(big) - 1)
            n = np.where(big[at] == keys, parts[at], 1).astype(np.uint64)
            keys = keys + mix64(ids.view(np.uint64)) % n * np.uint64(0x9E3779B97F4A7C15)
        return (mix64(keys) % np.uint64(self.groups)).astype(np.int32)

    def visited(self, keys: np.ndarray) -> np.ndarray:
        """All groups that may hold rows of the bucket keys."""
        big, parts = self.split
        out = [(mix64(keys) % np.uint64(self.groups))]
        for key in np.intersect1d(keys, big):
            n = int(parts[np.searchsorted(big, key)])
            out.append(mix64(key + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.groups))
        return np.unique(np.concatenate(out)).astype(np.int32)


def fit_probes(plan: Plan, sample: pa.Table, k: int) -> np.ndarray | None:
    """The shortest probing sequence that finds ``TARGET`` of the sample's own
    nearest neighbours; None where none does."""
    sequence = probing_sequence(plan.k, MOST_PROBES)
    ranks = []
    for dim, rows, x in vectors_of(sample["embedding"].combine_chunks()):
        if len(rows) < 2:
            continue
        hashing = plan.hashing(dim)
        codes = hashing.rows(x)
        for i in range(0, len(x), max(1, len(sample) // SAMPLE_QUERIES)):
            scores = x @ x[i]
            scores[i] = -np.inf
            true = np.argsort(-scores)[:min(k, len(x) - 1)]
            rank = np.full(len(true), len(sequence))
            for t, probes in enumerate(hashing.probes(x[i], sequence)):
                order = np.argsort(probes, kind="stable")
                at = np.minimum(np.searchsorted(probes[order], codes[true, t]), len(order) - 1)
                rank = np.minimum(rank, np.where(probes[order[at]] == codes[true, t], order[at], len(sequence)))
            ranks.append(rank)
    if not ranks:
        return sequence[:1]
    ranks = np.sort(np.concatenate(ranks))
    need = int(ranks[int(np.ceil(TARGET * len(ranks))) - 1]) + 1
    return sequence[:need] if need <= len(sequence) else None


def _index_rows(rows: DataFrame, plan: Plan) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for dim, at, x in vectors_of(batch.column("embedding")):
                keys = plan.keys(plan.hashing(dim).rows(x))
                n, column = len(at), batch.column("embedding").take(pa.array(at))
                for t in range(plan.tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(plan.group(keys[:, t], ids[at])), pa.array(np.zeros(n, np.int32)), pa.array(keys[:, t].view(np.int64)), pa.array(ids[at]), column],
                        ["part", "kind", "key", "vec_id", "embedding"])

    return rows.mapInArrow(run, f"part int, kind int, key long, vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}")


def _query_rows(rows: DataFrame, plan: Plan, everywhere: bool) -> DataFrame:
    """Each query once per group it visits."""
    def run(batches):
        for batch in batches:
            groups = []
            for dim, at, x in vectors_of(batch.column("embedding")):
                hashing = plan.hashing(dim)
                for i, q in zip(at, x):
                    go = everywhere or len(plan.sequence) * plan.tables > 4 * plan.groups
                    part = np.arange(plan.groups, dtype=np.int32) if go else plan.visited(plan.keys(hashing.probes(q, plan.sequence).T).ravel())
                    groups.append((np.full(len(part), i), part))
            for some in range(0, len(groups), 64):
                row, part = (np.concatenate(c) for c in zip(*groups[some:some + 64]))
                n = len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int64)), batch.column("vec_id").take(pa.array(row)), batch.column("embedding").take(pa.array(row))],
                    ["part", "kind", "key", "vec_id", "embedding"])

    return rows.mapInArrow(run, f"part int, kind int, key long, vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}")


class Group:
    """The buckets of one group, in memory."""

    def __init__(self, plan: Plan):
        self.plan, self.parts, self.made = plan, {}, None

    def add(self, batch: pa.RecordBatch) -> None:
        keys, ids = batch.column("key").to_numpy().view(np.uint64), batch.column("vec_id").to_numpy()
        for dim, at, x in vectors_of(batch.column("embedding")):
            self.parts.setdefault(dim, []).append((keys[at], ids[at], x))

    def close(self) -> None:
        self.made = {}
        for dim in list(self.parts):
            keys, ids, x = (np.concatenate(c) for c in zip(*self.parts.pop(dim)))
            order = np.argsort(keys, kind="stable")
            keys, begin = np.unique(keys[order], return_index=True)
            self.made[dim] = keys, np.append(begin, len(order)), ids[order], x[order]

    def candidates(self, q: np.ndarray, everywhere: bool) -> np.ndarray:
        keys, begin, ids, _ = self.made[len(q)]
        if everywhere:
            return np.arange(len(ids))
        wanted = self.plan.keys(self.plan.hashing(len(q)).probes(q, self.plan.sequence).T).ravel()
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        at = np.unique(at[keys[at] == wanted])
        n = begin[at + 1] - begin[at]
        return np.repeat(begin[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    def search(self, batch: pa.RecordBatch, k: int, everywhere: bool):
        own = batch.column("vec_id").to_numpy()
        for dim, at, queries in vectors_of(batch.column("embedding")):
            if dim not in self.made:
                continue
            _, _, ids, x = self.made[dim]
            step = max(1, min(256, BLOCK // len(ids)))
            for some in range(0, len(at), step):
                block = queries[some:some + step]
                found = [self.candidates(q, everywhere) for q in block]
                dense = x @ block.T if sum(map(len, found)) * 8 > len(ids) * len(block) else None
                for i, rows in enumerate(found):
                    if len(rows):
                        rough = dense[rows, i] if dense is not None else x[rows] @ block[i]
                        slack = 1e-12 * self.plan.greatest * np.sqrt(block[i] @ block[i])
                        yield own[at[some + i]], *best(x, ids, rows, rough, block[i], own[at[some + i]], k, self.plan.tables, slack)


def _found(index: DataFrame, queries: DataFrame, plan: Plan, k: int, everywhere: bool = False) -> DataFrame:
    """(query_id, vec_id, score): each group's best k of each query."""
    def run(batches):
        group = Group(plan)
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            cut = int(np.searchsorted(kind, 1))
            if cut:
                group.add(batch.slice(0, cut))
            if cut == len(kind):
                continue
            if group.made is None:
                group.close()
            got = list(group.search(batch.slice(cut), k, everywhere))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]).astype(np.int64)),
                                                  pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))], ["query_id", "vec_id", "score"])

    both = _index_rows(index, plan).unionByName(_query_rows(queries, plan, everywhere))
    dealt = both.repartitionById(plan.groups, "part").sortWithinPartitions("kind")
    return dealt.select("kind", "key", "vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")


def _one_per_id(vectors: DataFrame) -> DataFrame:
    """Rows that share an id: the least vector.  Only repeated ids are grouped."""
    again = staged(vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "ann-repeated")
    n = again.count()
    if not n:
        return vectors
    least = vectors.join(small(again, n), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return vectors.join(small(again, n), "vec_id", "left_anti").unionByName(least)


def _first_copies(vectors: DataFrame, keep: int) -> DataFrame:
    """Of vectors with more than ``keep`` copies those with the first ids."""
    marked = vectors.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(SEED), "embedding"))
    many = staged(marked.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > keep).select("h1", "h2"), "ann-copies")
    n = many.count()
    if not n:
        return vectors
    ids = marked.select("h1", "h2", "vec_id").join(small(many, n), ["h1", "h2"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    rank = F.row_number().over(Window.partitionBy("h1", "h2", "salt").orderBy("vec_id"))
    ids = ids.withColumn("rank", rank).where(F.col("rank") <= keep)
    last = staged(ids.withColumn("rank", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("rank") == keep)
                  .select("h1", "h2", F.col("vec_id").alias("last")), "ann-last")
    return marked.join(small(last, n), ["h1", "h2"], "left").where(F.col("last").isNull() | (F.col("vec_id") <= F.col("last"))).select("vec_id", "embedding")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES) -> DataFrame:
    """vectors(vec_id, embedding, …), queries (rows of it) → query_id, rank,
    vec_id, score: each query's k nearest found, nearest first."""
    spark = vectors.sparkSession
    prepare(spark)
    clean = _one_per_id(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    asked = clean.join(asked, "vec_id", "left_semi")
    index = staged(_first_copies(clean, k + 1), "ann-index")
    asked = staged(asked, "ann-queries")
    n, greatest, longest = index.agg(F.count(F.lit(1)), F.max(norm_of(F.col("embedding"))), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    functions = int(np.clip(round(np.log2(n / PER_BUCKET)), 4, 48))
    per_group = max(1, GROUP_BYTES // (8 * longest))
    plan = Plan(functions, greatest, max(-(-n * tables // per_group), min(spark.sparkContext.defaultParallelism, -(-n // PER_BUCKET))), tables)
    share = min(1.0, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * longest)) / n)
    sample = index.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sequence = fit_probes(plan, sample.toArrow(), k)
    if sequence is not None:
        plan.sequence = sequence
        plan.split = _split_buckets(index, plan, per_group)
    found = staged(_found(index, asked, plan, k, sequence is None), "ann-found")
    if sequence is not None:  # too few met: those queries visit every bucket
        by_length = index.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("rows"))
        met = found.select("query_id", "vec_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("met"))
        short = (asked.join(met, F.col("vec_id") == F.col("query_id"), "left").join(by_length, F.size("embedding") == F.col("dim"))
                 .where(F.coalesce("met", F.lit(0)) < F.least(F.lit(k), F.col("rows") - 1)).select("vec_id", "embedding"))
        short = staged(short, "ann-short")
        if short.limit(1).count():
            found = found.unionByName(_found(index, short, plan, k, True))
    met = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top_k(met, "query_id", "score", "vec_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _split_buckets(index: DataFrame, plan: Plan, per_group: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, parts) of the buckets with more rows than a group takes: at most
    one of them for each group's worth of rows."""
    def run(batches):
        for batch in batches:
            for dim, _, x in vectors_of(batch.column("embedding")):
                keys, n = np.unique(plan.keys(plan.hashing(dim).rows(x)).ravel(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    rows = index.select("embedding").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > per_group).toArrow()
    keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], -(-n[order] // per_group)
