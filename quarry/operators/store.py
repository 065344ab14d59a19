"""Table maintenance on plain Parquet: latest version per key, upserts,
insert-if-absent, mapping replacement, set diffs and a content-addressed
blob store.  Writes are staged to a fresh location under the shared
checkpoint folder and then read back (never overwrite a path being read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import released, scratch_path


def _newest(others: list[str], ts_col: str):
    """The row with the latest time; of several at one time the same one wins in every run."""
    return F.max_by(F.struct(*others), F.struct(F.col(ts_col), F.xxhash64(*others)))


def latest_by_key(df: DataFrame, keys: list[str], ts_col: str) -> DataFrame:
    """Newest row per key (``max_by`` hash aggregate: partial per partition,
    so a hot key is reduced map-side before the shuffle)."""
    others = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(_newest(others, ts_col).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in others])


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], ts_col: str,
           keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Merge ``updates`` into ``current`` on ``keys``: a key's newest update
    replaces its row unless the current row is newer; ``keep_first`` columns
    keep their earliest value (e.g. created_at).  One aggregate."""
    both = current.unionByName(updates.select(*current.columns))
    others = [c for c in current.columns if c not in keys]
    agg = both.groupBy(*keys).agg(_newest(others, ts_col).alias("_r"), *[F.min(c).alias(f"_first_{c}") for c in keep_first])
    return agg.select(*[F.col(c) if c in keys else F.col(f"_first_{c}").alias(c) if c in keep_first else F.col("_r")[c].alias(c)
                        for c in current.columns])


def insert_if_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append only rows whose key is not present yet (anti join)."""
    fresh = new.select(*current.columns).dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
    return current.unionByName(fresh)


def replace_mapping(current: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Replace all rows of every owner present in ``new`` (e.g. a file's chunk list)."""
    owners = new.select(owner).distinct()
    return current.join(owners, owner, "left_anti").unionByName(new.select(*current.columns))


def set_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows tagged 'new' (only in new), 'kept' (both) or 'gone' (only in old)."""
    o = old.select(*keys).distinct().withColumn("_o", F.lit(True))
    n = new.select(*keys).distinct().withColumn("_n", F.lit(True))
    j = o.join(n, keys, "full")
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").otherwise("kept")
    return j.select(*keys, state.alias("state"))


def write_staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a new table version to a fresh folder and read it back.  The shuffle
    files behind it go as soon as it is written; texts are packed tightly, as an
    ingest holds several copies of them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    with released(spark):
        w.parquet(path)
    return spark.read.parquet(path)


class BlobStore:
    """Content-addressed blobs ``(sha256, content, content_type, length)`` as
    a DataFrame; ``put`` never rewrites existing blobs, ``retype`` sets the
    content type found later, ``delete`` is idempotent, ``get`` returns null content for missing keys."""

    def __init__(self, blobs: DataFrame):
        self.blobs = blobs

    @staticmethod
    def from_bytes(df: DataFrame, content_col: str = "content",
                   content_type: str = "application/octet-stream") -> DataFrame:
        return df.select(F.sha2(F.col(content_col), 256).alias("sha256"), F.col(content_col).alias("content"),
                         F.lit(content_type).alias("content_type"),
                         F.octet_length(F.col(content_col)).cast("bigint").alias("length")).dropDuplicates(["sha256"])

    def put(self, new: DataFrame) -> "BlobStore":
        return BlobStore(insert_if_absent(self.blobs, new, ["sha256"]))

    def retype(self, types: DataFrame) -> "BlobStore":
        """types(sha256, content_type): blobs saved under a general type get the right one."""
        t = types.groupBy("sha256").agg(F.max("content_type").alias("_t"))
        out = self.blobs.join(t, "sha256", "left").withColumn("content_type", F.coalesce("_t", "content_type")).drop("_t")
        return BlobStore(out.select(*self.blobs.columns))

    def get(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.blobs, "sha256", "left")

    def delete(self, keys: DataFrame) -> "BlobStore":
        return BlobStore(self.blobs.join(keys.select("sha256"), "sha256", "left_anti"))

    def persist(self, name: str = "blobs") -> "BlobStore":
        """Write partitioned by the first two hex digits of the hash."""
        staged = write_staged(self.blobs.withColumn("prefix", F.substring("sha256", 1, 2)), name, ["prefix"])
        return BlobStore(staged.drop("prefix"))
