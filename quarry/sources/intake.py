"""Ingest intake: validate request rows, pick the file or URL channel, merge meta.

Input ``requests(source, source_id, file BINARY, filename, meta STRING, max_age INT)``;
one ``select`` computes everything, then ``accepted`` / ``rejected`` are two
filters over the same lazily evaluated projection (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_sha256, py_strip
from ..session import DEFAULT_MAX_AGE

# Texts of the interface.
REJECT_SOURCE = "source and source_id required"
REJECT_META = "meta must be a valid JSON object"
REJECT_EMPTY = "file or url required"


def merge_meta(left: Column, right: Column) -> Column:
    """``left | right`` for string maps: keys of ``right`` win (no session
    config needed, unlike ``map_concat`` under a dedup policy)."""
    keep = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(keep, right)


def is_json_object(s: Column) -> Column:
    """Valid JSON whose first non-blank character opens an object."""
    return F.regexp_replace(s, "^[ \t\n\r]+", "").startswith("{") & F.try_parse_json(s).isNotNull()


def intake(requests: DataFrame) -> DataFrame:
    """Adds: reject_reason, channel ('file' / 'url'), meta MAP, filename, url,
    sha256 (file channel), max_age (default 86400).  Stacked projections:
    each cleaned field is computed once and referenced by the next step."""
    base = requests.select(
        "*",
        F.nullif(py_strip(F.col("source")), F.lit("")).alias("clean_source"),
        F.nullif(py_strip(F.col("source_id")), F.lit("")).alias("clean_source_id"),
        is_json_object(F.col("meta")).alias("_ok_meta"),
        py_strip(F.col("filename")).alias("_upload"),
        (F.coalesce(F.octet_length("file"), F.lit(0)) > 0).alias("_has_file"))
    client = F.when(F.col("_ok_meta"), F.from_json(F.col("meta"), "map<string,string>"))
    with_name = F.when(F.col("file").isNotNull() & (F.col("_upload") != ""),
                       merge_meta(F.create_map(F.lit("filename"), F.col("_upload")), client)).otherwise(client)
    staged = base.select("*", with_name.alias("_m0"))
    raw_url = F.col("_m0")["url"]
    # a present, non-empty url is trimmed (it may become empty); else removed
    meta = F.when((raw_url.isNotNull()) & (raw_url != ""),
                  merge_meta(F.col("_m0"), F.create_map(F.lit("url"), py_strip(raw_url)))) \
            .otherwise(F.map_filter(F.col("_m0"), lambda k, v: k != "url"))
    staged = staged.select("*", meta.alias("_m1"))
    url = F.col("_m1")["url"]
    has_file = F.col("_has_file")
    reason = (F.when(F.col("clean_source").isNull() | F.col("clean_source_id").isNull(), F.lit(REJECT_SOURCE))
               .when(~F.col("_ok_meta"), F.lit(REJECT_META))
               .when(~has_file & F.coalesce(url == "", F.lit(True)), F.lit(REJECT_EMPTY)))
    staged = staged.select("*", reason.alias("reject_reason"))
    channel = F.when(F.col("reject_reason").isNull(), F.when(has_file, "file").otherwise("url"))
    staged = staged.select("*", channel.alias("channel"))
    # a file wins: its meta loses the url
    final_meta = F.when(F.col("channel") == "file", F.map_filter(F.col("_m1"), lambda k, v: k != "url")) \
                  .otherwise(F.col("_m1"))
    out = staged.select(
        "*", final_meta.alias("meta_map"),
        F.when(F.col("channel") == "url", url).alias("url"),
        F.when(F.col("channel") == "file", content_sha256(F.col("file"))).alias("sha256"),
        F.coalesce(F.col("max_age"), F.lit(DEFAULT_MAX_AGE)).alias("clean_max_age"))
    out = out.withColumn("clean_filename", F.col("meta_map")["filename"])
    return out.drop("_ok_meta", "_upload", "_has_file", "_m0", "_m1")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull())


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())
