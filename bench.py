"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line with per-query seconds.
Each query is executed fully through the ``noop`` sink (no collect)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.registry import load_all  # noqa: E402
from quarry.session import build_session  # noqa: E402

HEADLINE = ["str_4_chunks", "agg_1_dedup", "agg_2_chunk_dedup", "src_3_intake", "flt_2_route", "join_1_asof",
            "join_4_readiness", "ups_2_source", "top_1_cosine", "top_3_trigram", "top_5_bm25", "top_6_hybrid",
            "join_6_context", "tab_4_render", "str_9_html_markdown", "src_10_explode", "win_3_rowid",
            "top_2_ivf", "win_8_assemble", "stm_1_ingest", "stm_2_dedup", "ing_1_collection"]


def _sf_value(sf_dir: str):
    tag = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        return float(tag)
    except ValueError:
        return tag


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    reg = load_all()
    # warm-up: JVM class loading and Python workers
    reg["agg_1_dedup"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        t0 = time.time()
        reg[k].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": _sf_value(sf_dir),
                      "documents": docs,
                      **({"docs_per_sec_chunking": round(docs / times["str_4_chunks"], 1)} if "str_4_chunks" in times else {})}))
    spark.stop()


if __name__ == "__main__":
    main()
