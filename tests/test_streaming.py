import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.session import scratch_path
from quarry.streaming import ingest as ST

BASE = datetime(2024, 1, 1)
FETCH = "url string, ts timestamp_ntz"


def _arriving(spark, parts, schema):
    """A stream that reads one file for each of ``parts``, in order."""
    land = scratch_path(spark, "arrivals")
    for i, rows in enumerate(parts):
        if i:
            time.sleep(1.1)                   # the file source orders files by modification time
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{land}/a{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(land)


def _accepted(rows, hours=6):
    out, last = {}, {}
    for url, ts in sorted(rows, key=lambda r: r[1]):
        out[url, ts] = url not in last or ts - last[url] >= timedelta(hours=hours)
        if out[url, ts]:
            last[url] = ts
    return out


@pytest.mark.parametrize("shuffled,batches", [(False, 1), (False, 3), (True, 1), (True, 3)])
def test_throttle_is_the_same_for_all_arrivals(spark, shuffled, batches):
    rows = [(f"u{i % 4}", BASE + timedelta(minutes=37 * i)) for i in range(60)]
    if shuffled:
        random.Random(2).shuffle(rows)
    step = -(-len(rows) // batches)
    parts = [rows[i:i + step] for i in range(0, len(rows), step)] + [[("", datetime(2100, 1, 1))]]
    out = ST.run_to_table(ST.fetch_throttle(_arriving(spark, parts, FETCH), 6 * 3600, delay="3 days"), "throttle-test", spark).collect()
    assert {(r.url, r.ts): r.accepted for r in out} == _accepted(rows) and not any(r.late for r in out) and len(out) == len(rows)


def test_late_requests_leave_undecided(spark):
    parts = [[("u", BASE), ("u", BASE + timedelta(hours=30))], [("u", BASE + timedelta(hours=1)), ("u", BASE + timedelta(hours=40))], [("", datetime(2100, 1, 1))]]
    out = ST.run_to_table(ST.fetch_throttle(_arriving(spark, parts, FETCH), 6 * 3600, delay="1 hour"), "throttle-late", spark).collect()
    assert {(r.ts - BASE).total_seconds() / 3600: (r.accepted, r.late) for r in out} == {0: (True, False), 30: (True, False), 1: (None, True), 40: (True, False)}


def test_a_payload_that_only_arrives_late_is_kept(spark):
    hours = [0, 50, 1, 100, 51, 52]          # the third, fifth and sixth are behind the watermark
    rows = [(f"p{k % 5}", BASE + timedelta(hours=h)) for k, h in enumerate(hours)]
    s = _arriving(spark, [[r] for r in rows], "props string, ts timestamp")
    out = ST.run_new_rows(ST.dedup_stream(s, F.sha2("props", 256), "ts", "1 hour"), "late-dedup", spark).collect()
    assert sorted(r.props for r in out) == sorted({p for p, _ in rows})


NOTE = "parent string, child string, expected long"


@pytest.mark.parametrize("batches", [1, 4])
def test_readiness_is_the_same_for_all_batches(spark, batches):
    notes = [("a", f"c{i}", 700) for i in range(700)] + [("a", "c5", 700)] + [("b", "x", 1), ("b", "x", 1), ("c", "y", 2), ("d", None, 1)]
    random.Random(4).shuffle(notes)
    step = -(-len(notes) // batches)
    parts = [notes[i:i + step] for i in range(0, len(notes), step)] + [[("b", "x", 1), ("a", "c5", 700)]]
    out = ST.run_to_table(ST.readiness_stream(_arriving(spark, parts, NOTE)), "ready-test", spark).collect()
    assert sorted((r.parent, r.ready, r.n_seen, r.n_expected) for r in out) == [("a", True, 700, 700), ("b", True, 1, 1)]


def test_parents_that_wait_too_long_are_reported(spark):
    s = _arriving(spark, [[("a", "x", 2), ("b", "y", 1)]], NOTE)
    out = scratch_path(spark, "stuck")
    q = (ST.readiness_stream(s, timeout_ms=2000).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c")
         .trigger(processingTime="500 milliseconds").start())
    try:
        for _ in range(60):
            time.sleep(1)
            assert q.exception() is None
            try:
                got = {r.parent: (r.ready, r.n_seen) for r in spark.read.parquet(out).collect()}
            except Exception:
                got = {}
            if len(got) == 2:
                break
    finally:
        q.stop()
    assert got == {"a": (False, 1), "b": (True, 1)}


def test_a_run_takes_the_same_micro_batches_at_any_size(spark, tmp_path, monkeypatch):
    """Many files per micro-batch, not one: whole arrivals in the order of time."""
    import os
    from quarry.plans import q_stream as Q
    monkeypatch.setattr(Q, "ROWS_PER_FILE", 10)
    docs = spark.range(200).select("id", F.col("id").cast("string").alias("text"))
    path, files = Q._land(docs, spark, "test-land")
    assert files == 5 and len(spark.read.parquet(path).inputFiles()) == 20
    rows = spark.range(90).select(F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("url"),
                                  F.expr("CASE WHEN id < 3 THEN TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, cast(id AS int)) ELSE TIMESTAMP_NTZ'2024-02-01' + make_dt_interval(0, cast(id AS int)) END").alias("ts"))
    path, files = Q._land_in_order(rows, spark, "test-order", "ts")
    path = path.removeprefix("file:")
    arrivals = sorted(d for d in os.listdir(path) if d.startswith("arrival_"))
    assert len(arrivals) <= 4 and {sum(f.endswith(".parquet") for f in os.listdir(f"{path}/{d}")) for d in arrivals} == {files} and files > 1
    ends = [spark.read.parquet(f"{path}/{d}").agg(F.min("ts"), F.max("ts")).first() for d in arrivals]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]) if a[1] and b[0])
    assert sum(spark.read.parquet(f"{path}/{d}").count() for d in arrivals) == 90
