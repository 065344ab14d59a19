"""Tabular files → markdown tables, as one projection over a DataFrame.

* struct columns are flattened repeatedly to ``col.field`` (fields go to the
  end, like the reference's unnest + hstack),
* numeric/boolean list columns whose longest list exceeds 4 are dropped (one
  aggregate decides for every list column), other lists are joined by ", ",
* a 1-based ``RowID`` comes first, every cell is sanitized to one line,
* the table renders as lines (header, separator, one line per row); large
  tables stay as rows, never one string in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode White_Space (what the reference's tabular regex treats as \s):
# Python's isspace minus the separators \x1c-\x1f.
_WS_CPS = [c for c in range(0x110000) if chr(c).isspace() and not 0x1c <= c <= 0x1f]
WS_TAB = "".join(f"\\x{{{c:x}}}" for c in _WS_CPS)
MAX_LIST_LEN = 4
#: Largest table of offsets, in rows, that is offered as a broadcast side.
OFFSET_ROWS = 200_000
#: Lines of a table whose lengths are summed in one task.
LINE_BLOCK = 10_000
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
           T.BooleanType)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def list_lengths(df: DataFrame) -> dict[str, int]:
    """Longest list of every numeric/boolean list column, found in one
    aggregate over the (possibly nested) columns; the result is one row."""
    exprs, names = [], []

    def walk(prefix: str, col: Column, dt):
        if isinstance(dt, T.StructType):
            for f in dt.fields:
                walk(f"{prefix}.{f.name}", col[f.name], f.dataType)
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, NUMERIC):
            names.append(prefix)
            exprs.append(F.max(F.size(col)).alias(f"c{len(exprs)}"))
    for f in df.schema.fields:
        walk(f.name, F.col(_q(f.name)), f.dataType)
    if not exprs:
        return {}
    row = df.agg(*exprs).first()
    return {n: (row[i] if row[i] is not None else 0) for i, n in enumerate(names)}


def _stringify_list(col: Column, dt: T.ArrayType) -> Column:
    if isinstance(dt.elementType, (T.StructType, T.ArrayType, T.MapType)):
        item = lambda x: F.coalesce(F.to_json(x), F.lit(""))
    else:
        item = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.coalesce(F.array_join(F.transform(col, item), ", "), F.lit(""))


def flatten(df: DataFrame) -> DataFrame:
    """Repeated struct unnesting and list handling, planned on the schema and
    applied as a single ``select``."""
    lens = list_lengths(df)
    cols: list[tuple[str, Column, T.DataType]] = [(f.name, F.col(_q(f.name)), f.dataType) for f in df.schema.fields]
    while any(isinstance(dt, (T.StructType, T.ArrayType)) for _, _, dt in cols):
        nxt: list[tuple[str, Column, T.DataType]] = []
        tail: list[tuple[str, Column, T.DataType]] = []
        for name, c, dt in cols:
            if isinstance(dt, T.StructType):
                tail.extend((f"{name}.{f.name}", c[f.name], f.dataType) for f in dt.fields)
            elif isinstance(dt, T.ArrayType):
                if isinstance(dt.elementType, NUMERIC) and lens.get(name, 0) > MAX_LIST_LEN:
                    continue
                nxt.append((name, _stringify_list(c, dt), T.StringType()))
            else:
                nxt.append((name, c, dt))
        cols = nxt + tail
    return df.select(*[c.alias(n) for n, c, _ in cols])


def sanitize(c: Column) -> Column:
    """Cell text: null → '', whitespace runs → one space, '|' → '¦', trimmed."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = F.regexp_replace(s, f"[{WS_TAB}]+", " ")
    s = F.replace(s, F.lit("|"), F.lit("¦"))
    return F.regexp_replace(s, f"^[{WS_TAB}]+|[{WS_TAB}]+$", "")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only where the counted rows are within the bound."""
    return F.broadcast(df) if rows <= OFFSET_ROWS else df


def _before(counts: DataFrame, n: Column, order: list[str]) -> DataFrame:
    """Rows before each part: one window over one row per part."""
    return counts.withColumn("_off", F.coalesce(F.sum(n).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def row_index(df: DataFrame, order: list[str], name: str = "RowID", partitions: int | None = None) -> DataFrame:
    """1-based row number in ``order`` without a single-partition window:
    range-partition and sort, count rows per partition, and join each
    partition's offset (one small row per partition).  The sorted frame is
    checkpointed to the shared checkpoint folder first so recomputed tasks see
    the same partitioning."""
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    srt = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
             .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
             .checkpoint())
    parts = _before(srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0")), F.col("_n"), ["_pid"])
    rid = (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("bigint")
    return srt.join(_bounded(parts.drop("_n"), n), "_pid").select(rid.alias(name), *[F.col(_q(c)) for c in df.columns])


def file_row_index(df: DataFrame, name: str = "RowID") -> DataFrame:
    """1-based row number in file order of a frame as a file reader gives it:
    by file path, start of the split in the file, and place in the split.

    A split is read front to back by one task, so its rows have consecutive
    ids; a first scan counts them per split, the offsets (one row per split) are
    joined to the second.  Rows are neither sorted nor stored."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    tagged = df.select(*[F.col(_q(c)) for c in df.columns], *place, F.monotonically_increasing_id().alias("_mid"))
    splits = _before(df.select(*place, F.monotonically_increasing_id().alias("_mid")).groupBy("_file", "_block")
                     .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0")), F.col("_n"), ["_file", "_block"])
    rid = (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("bigint")
    return tagged.join(_bounded(splits.drop("_n"), len(df.inputFiles())), ["_file", "_block"]).select(rid.alias(name), *[F.col(_q(c)) for c in df.columns])


def to_table(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Flattened, row-indexed, sanitized string table; rows numbered in ``order``,
    or without one in file order (``df`` then comes from a file reader)."""
    if order is None:
        ordered = flatten(file_row_index(df))
    else:
        ordered = row_index(flatten(df), list(order))
    return ordered.select(*[sanitize(F.col(_q(c))).alias(c) for c in ordered.columns])


def markdown_lines(table: DataFrame) -> DataFrame:
    """(line_no, line): 0 = header, 1 = separator, RowID + 1 = each row."""
    cols = table.columns
    header = " | ".join(cols)
    sep = " | ".join("-" for _ in cols)
    spark = table.sparkSession
    head = spark.createDataFrame([(0, header), (1, sep)], "line_no bigint, line string")
    rows = table.select((F.col("RowID").cast("bigint") + 1).alias("line_no"),
                        F.concat_ws(" | ", *[F.col(_q(c)) for c in cols]).alias("line"))
    return head.unionByName(rows)


def table_chunks(lines: DataFrame, target: int, block_rows: int = LINE_BLOCK) -> DataFrame:
    """(line_no, line) of one table → (idx, markdown): chunks of whole rows, each
    under the table's header and separator.

    A row goes to the chunk in whose ``target`` characters (less the header's) its
    own first character falls, by prefix sums of the line lengths: sums per
    block of lines, one window over the blocks, one inside each block.  A chunk is
    over the target by less than its last row; the table is never one string."""
    head = lines.where("line_no < 2").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("head"))
    top = head.first()["head"]
    room = max(target - len(top) - 1, 1)
    rows = lines.where("line_no >= 2").select("line_no", "line", (F.length("line") + 1).alias("n"), F.floor(F.col("line_no") / block_rows).alias("block"))
    blocks = _before(rows.groupBy("block").agg(F.sum("n").alias("_n")), F.col("_n"), ["block"]).drop("_n")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.withColumn("inside", inside).join(blocks, "block").withColumn("idx", F.floor((F.col("_off") + F.col("inside")) / room))
    body = cut.groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    numbered = _before(body.select("idx"), F.lit(1), ["idx"])
    return body.join(numbered, "idx").select(F.col("_off").cast("bigint").alias("idx"), F.concat(F.lit(top + "\n"), F.col("body")).alias("markdown"))


def profile(table: DataFrame) -> dict:
    return {"num_rows": table.count(), "num_cols": len(table.columns), "columns": table.columns}
