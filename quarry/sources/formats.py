"""Tabular file scans: Parquet, JSON document, NDJSON and CSV with a sniffed
dialect, plus the format cascade over a folder of mixed files.

Files are classified once from a ``binaryFile`` scan (magic bytes and text
shape, see ``quarry.functions.sniff``); each class is then read by one
native reader over its whole path list (never a reader per file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sniff import CSV_DELIMS, _fields, csv_dialect, dialect_lines, is_json_doc, is_ndjson, sniff_kind
from ..functions.text import bind, normalize_text

NUM_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def csv_has_header(text: Column, dialect: Column) -> Column:
    """Header vote: no field of the first line is numeric, and some column is
    numeric in every following line."""
    lines = dialect_lines(text, dialect)
    out = F.lit(None).cast("boolean")
    for d in CSV_DELIMS:
        out = F.when(dialect["delimiter"] == d, bind(lines, _header_vote(d))).otherwise(out)
    return out


def _header_vote(d: str):
    def vote(lines):
        first, rest = _fields(lines[0], d), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))
        numeric = F.exists(F.sequence(F.lit(0), F.size(first) - 1), lambda i: F.forall(rest, lambda ln: F.trim(_fields(ln, d)[i]).rlike(NUM_RE)))
        return F.forall(first, lambda f: ~F.trim(f).rlike(NUM_RE)) & numeric
    return vote


def sniff_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, format, dialect, header, names) for every file under ``paths``;
    ``names`` is the header line of a CSV file that has one."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    head = F.col("content")
    text = normalize_text(head)
    kind = sniff_kind(head)
    raw = raw.select("path", text.alias("text"), kind.alias("kind"), csv_dialect(text).alias("dialect"))
    text, d = F.col("text"), F.col("dialect")
    fmt = (F.when(F.col("kind") == "parquet", "parquet").when(is_json_doc(text), "json")
            .when(is_ndjson(text), "ndjson").when(d.isNotNull(), "csv").otherwise(F.lit(None)))
    is_csv = fmt == "csv"
    return raw.select("path", fmt.alias("format"), F.when(is_csv, d).alias("dialect"),
                      F.when(is_csv, csv_has_header(text, d)).alias("header"),
                      F.when(is_csv, F.regexp_extract(text, r"^\s*([^\n]*)", 1)).alias("first")) \
        .select("path", "format", "dialect", "header", F.when(F.col("header"), F.col("first")).alias("names"))


def read_class(spark: SparkSession, fmt: str, paths: list[str], dialect: dict | None = None,
               header: bool | None = None) -> DataFrame:
    """One native reader over all files of a class; rows carry their file.  CSV
    files are split over tasks unless a quoted field of theirs holds a line break."""
    if not paths:
        return None
    if fmt == "parquet":
        df = spark.read.option("mergeSchema", True).parquet(*paths)
    elif fmt == "json":
        df = spark.read.option("multiLine", True).json(paths)
    elif fmt == "ndjson":
        df = spark.read.json(paths)
    else:
        quote = dialect["quote"]
        df = (spark.read.option("sep", dialect["delimiter"]).option("header", bool(header)).option("inferSchema", True)
              .option("quote", quote or "\u0000").option("escape", dialect["escape"] or quote or "\u0000").option("multiLine", bool(dialect["multiline"]))
              .option("samplingRatio", 1.0).option("mode", "PERMISSIVE").csv(paths))
    return df.withColumn("_file", F.col("_metadata.file_path"))


def read_cascade(spark: SparkSession, folder: str) -> list[tuple[dict, DataFrame]]:
    """Classify every file of a folder and read each (format, dialect, header
    line) class: CSV files share a reader only if their columns are the same.

    The classification result has one row per *file* (a listing, not data,
    like the file listing Spark itself keeps on the driver) and is collected
    to plan one reader per class."""
    listing = sniff_files(spark, folder).filter(F.col("format").isNotNull()) \
        .select("path", "format", "dialect", "header", "names").collect()
    classes: dict[tuple, list[str]] = {}
    for r in listing:
        classes.setdefault((r["format"], r["dialect"], r["header"], r["names"]), []).append(r["path"])
    out = []
    for (fmt, dialect, header, _), paths in sorted(classes.items(), key=lambda kv: str(kv[0])):
        dialect = dialect.asDict() if dialect else None
        df = read_class(spark, fmt, paths, dialect, header)
        out.append(({"format": fmt, "delimiter": dialect and dialect["delimiter"], "dialect": dialect, "header": header}, df))
    return out


def write_csv_text(df: DataFrame, path: str, delimiter: str, header: bool) -> None:
    (df.write.mode("errorifexists").option("sep", delimiter).option("header", header)
       .option("quoteAll", False).csv(path))


def write_json_arrays(df: DataFrame, path: str, rows_per_file: int = 10000) -> None:
    """Rows as JSON array documents of about ``rows_per_file`` rows each (rows
    spread by hash; the number of documents grows with the table, so no
    document collects an unbounded group)."""
    files = max(1, -(-df.count() // rows_per_file))
    key = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files))
    docs = (df.select(key.alias("_g"), F.to_json(F.struct(*df.columns)).alias("_j"))
              .groupBy("_g").agg(F.concat(F.lit("["), F.listagg("_j", ","), F.lit("]")).alias("value")))
    # one document per file: each group is written under its own folder
    docs.write.mode("errorifexists").partitionBy("_g").text(path)
