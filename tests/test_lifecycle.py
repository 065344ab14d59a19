import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.operators import lifecycle as L
from quarry.sources.intake import REJECT_EMPTY, REJECT_META, REJECT_SOURCE, intake, merge_meta


def test_readiness_parent_waits_for_children(spark):
    t = datetime(2024, 1, 1)
    files = spark.createDataFrame([("P", t), ("c1", t), ("c2", None), ("Q", t), ("c3", t)],
                                  "sha256 string, parsed_at timestamp_ntz")
    edges = spark.createDataFrame([("P", "c1"), ("P", "c2"), ("Q", "c3")], "parent_sha256 string, child_sha256 string")
    got = {r.sha256: r.ready for r in L.readiness(files, edges).collect()}
    assert got == {"P": False, "Q": True, "c1": True, "c2": False, "c3": True}


def test_orphan_generations(spark):
    files = spark.createDataFrame([("arc",), ("m1",), ("m2",), ("kept",), ("shared",)], "sha256 string")
    sources = spark.createDataFrame([("kept",)], "file_sha256 string")
    edges = spark.createDataFrame([("arc", "m1"), ("arc", "m2"), ("arc", "shared"), ("kept", "shared")],
                                  "parent_sha256 string, child_sha256 string")
    got = {r.sha256: r.generation for r in L.orphan_generations(files, sources, edges).collect()}
    assert got == {"arc": 1, "m1": 2, "m2": 2}
    one = {r.sha256 for r in L.orphan_sweep(files, sources, edges).collect()}
    assert one == {"arc"}


def test_asof_matches_brute_force_with_hot_key(spark):
    rnd = random.Random(3)
    base = datetime(2024, 1, 1)
    right = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", base + timedelta(seconds=rnd.randint(0, 400000)),
              f"v{i}") for i in range(600)]
    left = [(i, "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 6)}", base + timedelta(seconds=rnd.randint(0, 400000)))
            for i in range(500)]
    R = spark.createDataFrame(right, "k string, rts timestamp_ntz, v string")
    Lf = spark.createDataFrame(left, "id int, k string, ts timestamp_ntz")
    got = {r.id: r.asof_v for r in L.asof_latest(Lf, R, "k", "ts", "rts", ["v"], bucket_seconds=3600).collect()}
    for i, k, ts in left:
        cands = [(rt, v) for kk, rt, v in right if kk == k and rt <= ts]
        want = max(cands)[1] if cands else None
        assert got[i] == want, (i, k, ts)


def test_intake_rejects_and_merge(spark):
    rows = [("  ", "id", None, None, "{}", None), ("s", "1", None, None, "[]", None), ("s", "2", None, None, "x", None),
            ("s", "3", None, None, '{"url": "  "}', None), ("s", "4", bytearray(b"data"), " up.txt ", '{"filename": "mine"}', 5),
            ("s", "5", None, None, '{"url": " https://a.b/c "}', None)]
    df = spark.createDataFrame(rows, "source string, source_id string, file binary, filename string, meta string, max_age int")
    got = {r.source_id: r for r in intake(df).collect()}
    assert got["id"].reject_reason == REJECT_SOURCE
    assert got["1"].reject_reason == REJECT_META and got["2"].reject_reason == REJECT_META
    assert got["3"].reject_reason == REJECT_EMPTY
    assert got["4"].channel == "file" and got["4"].clean_filename == "mine" and got["4"].clean_max_age == 5
    assert got["5"].channel == "url" and got["5"].url == "https://a.b/c" and got["5"].clean_max_age == 86400
    m = spark.range(1).select(merge_meta(F.create_map(F.lit("filename"), F.lit("up")),
                                         F.create_map(F.lit("filename"), F.lit("mine"))).alias("m")).first().m
    assert m == {"filename": "mine"}


def test_ancestors_terminate_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "d")],
                                  "parent_sha256 string, child_sha256 string")
    got = {(r.sha256, r.ancestor): r.depth for r in L.ancestors(edges).collect()}
    assert got[("b", "a")] == 1 and got[("a", "b")] == 1 and got[("a", "a")] == 2
    assert got[("d", "c")] == 1 and got[("d", "a")] == 2 and got[("d", "b")] == 3


def test_asof_includes_equal_time_and_earlier_buckets(spark):
    t = datetime(2024, 1, 1, 12, 0, 0)
    R = spark.createDataFrame([("k", t, "same"), ("k", t - timedelta(days=3), "old")],
                              "k string, rts timestamp_ntz, v string")
    Lf = spark.createDataFrame([(1, "k", t), (2, "k", t - timedelta(hours=1)), (3, "k", t - timedelta(days=4))],
                               "id int, k string, ts timestamp_ntz")
    got = {r.id: r.asof_v for r in L.asof_latest(Lf, R, "k", "ts", "rts", ["v"], bucket_seconds=3600).collect()}
    assert got == {1: "same", 2: "old", 3: None}
