"""Lifecycle operators over the plain tables (files, sources, url_files,
file_files, chunks, file_chunks): freshness, cache reuse, readiness,
orphan clean-up, referential checks, work queues and counts.

Every operator is a join / aggregation on hash keys; byte or text columns
are joined back last so shuffles move keys, not contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# ------------------------------------------------------------ freshness

def age_seconds(then: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", then, now)


def freshness_lookup(requests: DataFrame, url_files: DataFrame, ts_col: str = "ts",
                     max_age_col: str = "max_age") -> DataFrame:
    """Requests (url, ts, max_age) ⟕ url_files: ``hit`` when the cached fetch is
    not after the request and at most ``max_age`` seconds old; the cached
    file hash is returned on a hit, misses form the refetch list."""
    u = url_files.select(F.col("url").alias("_u"), F.col("file_sha256").alias("_sha"),
                         F.col("fetched_at").alias("_fetched"))
    j = requests.join(u, requests["url"] == u["_u"], "left")
    age = age_seconds(F.col("_fetched"), F.col(ts_col))
    hit = F.coalesce((age >= 0) & (age <= F.col(max_age_col)), F.lit(False))
    return (j.withColumn("hit", hit)
             .withColumn("file_sha256", F.when(hit, F.col("_sha")))
             .drop("_u", "_sha", "_fetched"))


def _bucket(c: str, seconds: int) -> Column:
    since = F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(c))
    return F.floor(since / seconds).cast("bigint")


def asof_latest(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
                payload: list[str], bucket_seconds: int = 3600) -> DataFrame:
    """As-of join: each left row gets the latest right row with the same key
    and ``right_ts <= left_ts`` (payload columns prefixed ``asof_``).

    Skew-safe: rows are cut into (key, time bucket) cells.  Inside a cell a
    running window carries the last right row forward (right before left at
    equal times; of right rows at one time the same one wins in every run).  Across cells, a per-cell summary table (one row per key
    and bucket, far smaller than the rows) carries the latest earlier right
    row with a second window.  A hot key spreads over as many tasks as it
    has buckets and no pair of rows is ever materialised.
    """
    pay = F.struct(*[F.col(c) for c in payload], F.col(right_ts).alias("_rts"))
    R = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), _bucket(right_ts, bucket_seconds).alias("_b"),
                     pay.alias("_pay"))
    pay_t = R.schema["_pay"].dataType
    row = F.struct(*[F.col(c) for c in left.columns])
    Lu = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), _bucket(left_ts, bucket_seconds).alias("_b"),
                     F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(pay_t).alias("_pay"))
    row_t = Lu.schema["_row"].dataType
    Ru = R.select("_k", "_t", "_b", F.lit(0).alias("_side"), F.lit(None).cast(row_t).alias("_row"), "_pay")
    w = (Window.partitionBy("_k", "_b").orderBy("_t", "_side", F.xxhash64("_pay"))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    U = (Lu.unionByName(Ru).withColumn("_in", F.last("_pay", ignorenulls=True).over(w))
           .filter(F.col("_side") == 1).select("_k", "_b", "_row", "_in"))
    rcells = R.groupBy("_k", "_b").agg(F.max_by("_pay", F.struct("_t", F.xxhash64("_pay"))).alias("_last"))
    lcells = U.select("_k", "_b").distinct()
    cells = lcells.join(rcells, ["_k", "_b"], "full")
    wc = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prev = cells.select("_k", "_b", F.last("_last", ignorenulls=True).over(wc).alias("_prev"))
    out = U.join(prev, ["_k", "_b"], "left")
    best = F.coalesce(F.col("_in"), F.col("_prev"))
    sel = [F.col("_row")[c].alias(c) for c in left.columns] + \
          [best[c].alias(f"asof_{c}") for c in payload] + [best["_rts"].alias(f"asof_{right_ts}")]
    return out.select(*sel)


# ------------------------------------------------------------ cache reuse

def split_cached(incoming: DataFrame, files: DataFrame, key: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(new, cached): left-anti / left-semi joins on the content hash against
    processed files, evaluated before any conversion work."""
    done = files.filter(F.col("parsed_at").isNotNull()).select(F.col("sha256").alias(key))
    return incoming.join(done, key, "left_anti"), incoming.join(done, key, "left_semi")


# ------------------------------------------------------------ readiness

def readiness(files: DataFrame, file_files: DataFrame) -> DataFrame:
    """Per file: indexable iff parsed itself and every child parsed.

    Children's states are joined onto edges, then aggregated per parent with
    ``bool_and`` (a partial aggregate, so a parent with a huge fan-out is
    combined map-side).  Files without children are ready by themselves.
    """
    st = files.select(F.col("sha256"), F.col("parsed_at").isNotNull().alias("parsed"))
    kids = (file_files.select("parent_sha256", "child_sha256")
            .join(st.select(F.col("sha256").alias("child_sha256"), F.col("parsed").alias("child_parsed")),
                  "child_sha256", "left")
            .groupBy("parent_sha256")
            .agg(F.count(F.lit(1)).alias("n_children"),
                 F.count_if(F.coalesce(F.col("child_parsed"), F.lit(False))).alias("n_children_parsed")))
    j = st.join(kids, st["sha256"] == kids["parent_sha256"], "left")
    return j.select("sha256", "parsed",
                    F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    F.coalesce("n_children_parsed", F.lit(0)).alias("n_children_parsed"),
                    (F.col("parsed") & (F.coalesce("n_children", F.lit(0))
                                        == F.coalesce("n_children_parsed", F.lit(0)))).alias("ready"))


# ------------------------------------------------------------ orphan sweep

def orphan_sweep(files: DataFrame, sources: DataFrame, file_files: DataFrame) -> DataFrame:
    """One sweep generation: files referenced by no source and no parent edge."""
    held = sources.select(F.col("file_sha256").alias("sha256")) \
        .unionByName(file_files.select(F.col("child_sha256").alias("sha256")))
    return files.select("sha256").join(held, "sha256", "left_anti")


def orphan_generations(files: DataFrame, sources: DataFrame, file_files: DataFrame,
                       max_generations: int | None = None) -> DataFrame:
    """Repeated sweeps to the fixpoint: (sha256, generation) of every deleted
    file.  Deleting a parent removes its edges (cascade), so its children may
    go in the next generation.  After the first sweep only the children of the
    last generation are candidates: a child goes once its deleted parents are
    all its parents.  Generations are checkpointed to the shared folder.  Files
    on cycles or reachable from a source are never deleted.  A caller's bound
    that is reached raises."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(files.sparkSession)
    edges = file_files.select("parent_sha256", "child_sha256").distinct().checkpoint()
    src = sources.select(F.col("file_sha256").alias("sha256")).distinct()
    free = files.select("sha256").distinct().join(src, "sha256", "left_anti").checkpoint()
    held = edges.select(F.col("child_sha256").alias("sha256"))
    gone = free.join(held, "sha256", "left_anti").withColumn("generation", F.lit(1)).checkpoint()
    deleted, last, gen = gone, gone, 1
    parents = edges.groupBy("child_sha256").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    while not last.isEmpty():
        if max_generations is not None and gen >= max_generations:
            raise RuntimeError(f"orphan sweep not finished after {max_generations} generations")
        gen += 1
        touched = edges.join(last.select(F.col("sha256").alias("parent_sha256")), "parent_sha256", "left_semi").select("child_sha256").distinct()
        lost = (edges.join(touched, "child_sha256", "left_semi").join(deleted.select(F.col("sha256").alias("parent_sha256")), "parent_sha256", "left_semi")
                .groupBy("child_sha256").agg(F.count(F.lit(1)).alias("k")))
        last = (lost.join(parents, "child_sha256").filter("k = n").select(F.col("child_sha256").alias("sha256"))
                .join(free, "sha256", "left_semi").join(deleted.select("sha256"), "sha256", "left_anti")
                .withColumn("generation", F.lit(gen)).checkpoint())
        deleted = deleted.unionByName(last).checkpoint()
    return deleted


def cascade_mappings(file_chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Mapping rows whose file still exists (deleting a file deletes them)."""
    return file_chunks.join(files.select(F.col("sha256").alias("file_sha256")).distinct(), "file_sha256", "left_semi")


def orphan_chunks(chunks: DataFrame, file_chunks: DataFrame) -> DataFrame:
    """Chunks that no mapping holds."""
    return chunks.select("sha256").join(file_chunks.select(F.col("chunk_sha256").alias("sha256")), "sha256", "left_anti")


# ------------------------------------------------------------ referential

def referential_check(files: DataFrame, sources: DataFrame, url_files: DataFrame,
                      file_files: DataFrame, file_chunks: DataFrame | None = None,
                      chunks: DataFrame | None = None) -> DataFrame:
    """Rows violating the foreign keys: (constraint, key)."""
    f = files.select(F.col("sha256").alias("_k"))
    parts = [
        sources.select(F.lit("sources.file_sha256").alias("constraint"), F.col("file_sha256").alias("_k")),
        url_files.select(F.lit("url_files.file_sha256").alias("constraint"), F.col("file_sha256").alias("_k")),
        file_files.select(F.lit("file_files.parent_sha256").alias("constraint"), F.col("parent_sha256").alias("_k")),
        file_files.select(F.lit("file_files.child_sha256").alias("constraint"), F.col("child_sha256").alias("_k")),
    ]
    if file_chunks is not None:
        parts.append(file_chunks.select(F.lit("file_chunks.file_sha256").alias("constraint"),
                                        F.col("file_sha256").alias("_k")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    bad = out.join(f, "_k", "left_anti")
    if file_chunks is not None and chunks is not None:
        c = chunks.select(F.col("sha256").alias("_k"))
        bad = bad.unionByName(file_chunks.select(F.lit("file_chunks.chunk_sha256").alias("constraint"),
                                                 F.col("chunk_sha256").alias("_k")).join(c, "_k", "left_anti"))
    return bad.withColumnRenamed("_k", "key")


# ------------------------------------------------------------ queues

def unindexed(files: DataFrame) -> DataFrame:
    return files.filter(F.col("parsed_at").isNotNull() & F.col("indexed_at").isNull())


def unembedded(chunks: DataFrame, n: int) -> DataFrame:
    """Next ``n`` chunks to embed, oldest first (a top-n batch of the queue)."""
    return chunks.filter(F.col("embedding").isNull()).orderBy("created_at", "sha256").limit(n)


def expired(df: DataFrame, ts_col: str, as_of: Column, ttl_seconds: int) -> DataFrame:
    return df.filter(age_seconds(F.col(ts_col), as_of) > ttl_seconds)


# ------------------------------------------------------------ lineage closure

#: Edges that may pass the driver as a broadcast side.
BROADCAST_EDGES = 10_000


def ancestors(file_files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Transitive containment: (sha256, ancestor, depth) for every file and
    every file above it, at the shortest depth.  Level by level: the frontier
    (pairs found at the last depth) joins the edges on its ancestor; pairs
    already known are dropped, so cycles (an archive containing itself by
    hash) end the loop; each level is checkpointed to the shared folder.  A
    caller's bound that is reached with pairs left raises."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(file_files.sparkSession)
    edges = file_files.select(F.col("child_sha256").alias("_e_child"), F.col("parent_sha256").alias("_e_up")).distinct().checkpoint()
    known = edges.select(F.col("_e_child").alias("sha256"), F.col("_e_up").alias("ancestor"),
                         F.lit(1).alias("depth")).checkpoint()
    frontier, levels, d = known, [known], 1
    while True:
        d += 1
        # the edges above the frontier: few where many files share their containers
        tops = frontier.select(F.col("ancestor").alias("_e_child")).distinct()
        up = edges.hint("merge").join(tops, "_e_child", "left_semi").checkpoint()
        up = F.broadcast(up) if up.count() <= BROADCAST_EDGES else up.hint("merge")
        step = (frontier.join(up, F.col("ancestor") == F.col("_e_child"))
                        .select("sha256", F.col("_e_up").alias("ancestor"), F.lit(d).alias("depth"))
                        .distinct()
                        .join(known.select("sha256", "ancestor").hint("merge"), ["sha256", "ancestor"], "left_anti")
                        .checkpoint())
        if step.isEmpty():
            return known
        if max_depth is not None and d > max_depth:
            raise RuntimeError(f"containment is deeper than {max_depth}")
        levels.append(step)
        known = known.unionByName(step)
        if len(levels) % 16 == 0:      # keeps the plan short; levels themselves are already written
            known = known.checkpoint()
        frontier = step
