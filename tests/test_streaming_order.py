from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.plans import q_stream
from quarry.streaming import ingest as ST


def _events(spark):
    base = datetime(2024, 1, 1)
    rows = [(f"u{i % 7}", base + timedelta(minutes=37 * i), f"p{i if i % 3 else i // 30}") for i in range(240)]
    return rows, spark.createDataFrame(rows, "url string, ts timestamp_ntz, props string").repartition(6)


def test_many_files_arrive_in_order_of_time(spark, monkeypatch):
    monkeypatch.setattr(q_stream, "ROWS_PER_FILE", 20)
    rows, df = _events(spark)
    src = q_stream._land_in_order(df, spark, "landing-order", "ts")
    files = (spark.read.option("recursiveFileLookup", "true").parquet(src)
             .groupBy("_metadata.file_path", "_metadata.file_modification_time").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n"))
             .orderBy("file_modification_time").collect())
    assert len(files) == 12 and sum(r.n for r in files) == len(rows)
    assert all(x.hi < y.lo for x, y in zip(files, files[1:]))

    q_stream._close(spark, src, ("", datetime(2100, 1, 1), rows[0][2]), "url string, ts timestamp_ntz, props string")
    s = q_stream._arrivals(spark, src, "url string, ts timestamp_ntz, props string")
    got = {(r.url, r.ts): r.accepted for r in ST.run_to_table(ST.fetch_throttle(s, 6 * 3600), "order-throttle", spark).where("url <> ''").collect()}
    want, last = {}, {}
    for url, ts, _ in sorted(rows, key=lambda r: r[1]):
        want[url, ts] = url not in last or ts - last[url] >= timedelta(hours=6)
        if want[url, ts]:
            last[url] = ts
    assert got == want

    s = q_stream._arrivals(spark, src, "url string, ts timestamp, props string")
    out = ST.run_new_rows(ST.dedup_stream(s, F.sha2("props", 256), "ts", "1 hour"), "order-dedup", spark)
    assert sorted(r.props for r in out.collect()) == sorted({p for *_, p in rows})
