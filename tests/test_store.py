from datetime import datetime

from pyspark.sql import functions as F

from quarry.operators import store as S


def test_blob_store_put_get_delete_persist(spark):
    a = spark.createDataFrame([(bytearray(b"alpha"),), (bytearray(b"beta"),), (bytearray(b"alpha"),)], "content binary")
    store = S.BlobStore(S.BlobStore.from_bytes(a))
    assert store.blobs.count() == 2
    store = store.put(S.BlobStore.from_bytes(spark.createDataFrame([(bytearray(b"gamma"),), (bytearray(b"beta"),)],
                                                                  "content binary")))
    assert store.blobs.count() == 3
    gone = store.blobs.filter(F.col("length") == 4).select("sha256")
    store = store.delete(gone).delete(gone)          # idempotent
    persisted = store.persist("blobs-test")
    keys = spark.createDataFrame([("x",)], "sha256 string").unionByName(persisted.blobs.select("sha256"))
    got = {r.sha256: r.length for r in persisted.get(keys).collect()}
    assert got["x"] is None and sorted(v for v in got.values() if v) == [5, 5]


def test_upsert_keeps_first_created(spark):
    t = lambda d: datetime(2024, 1, d)
    cur = spark.createDataFrame([("k", "v1", t(1), t(1)), ("j", "w1", t(1), t(2))],
                                "key string, val string, created_at timestamp_ntz, touched_at timestamp_ntz")
    upd = spark.createDataFrame([("k", "v2", t(5), t(5)), ("k", "v3", t(4), t(4)), ("j", "w0", t(1), t(1))],
                                "key string, val string, created_at timestamp_ntz, touched_at timestamp_ntz")
    got = {r.key: (r.val, r.created_at.day, r.touched_at.day)
           for r in S.upsert(cur, upd, ["key"], "touched_at", keep_first=("created_at",)).collect()}
    assert got == {"k": ("v2", 1, 5), "j": ("w1", 1, 2)}


def test_set_diff_states(spark):
    old = spark.createDataFrame([("a",), ("b",)], "k string")
    new = spark.createDataFrame([("b",), ("c",)], "k string")
    got = {r.k: r.state for r in S.set_diff(old, new, ["k"]).collect()}
    assert got == {"a": "gone", "b": "kept", "c": "new"}


def test_write_staged_never_overwrites(spark):
    df = spark.range(3)
    a = S.write_staged(df, "staged")
    b = S.write_staged(df, "staged")
    assert a.inputFiles() != b.inputFiles() and a.count() == b.count() == 3


def test_staged_tables_are_packed_and_free_their_shuffles(spark):
    from quarry.operators.store import write_staged
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    out = write_staged(spark.range(1000).selectExpr("id % 10 AS k", "repeat('text ', 50) AS t").distinct(), "t-packed")
    assert out.count() == 10 and all(f.endswith(".zstd.parquet") for f in out.inputFiles())
    assert spark.conf.get(key) == setting
