"""Shared helpers: session preparation, staged tables, word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, ship_package

#: A word is a run of characters other than ASCII space and \t \n \v \f \r.
WORD_RE = r"[^\x20\x09-\x0D]+"
GAP_RE = r"[\x20\x09-\x0D]+"
#: A lower-case word of ASCII letters, digits and any non-ASCII character.
ALNUM_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts over which the rows of one key are dealt in a salted join.
SALTS = 16
#: Largest table, in rows, that is offered as a broadcast side.
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors and fix the shared checkpoint folder."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it
    back: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the counted ``rows`` are within ``bound``;
    beyond it the planner is free to shuffle."""
    return F.broadcast(df) if rows <= bound else df


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that grows with the corpus: it never passes the driver,
    however small the planner takes it to be from the size of its files."""
    return df.hint("merge")


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Join on ``keys`` where ``few`` has one row per key and ``many`` may have a
    third of its rows on one key: those are dealt over ``SALTS`` parts.  The
    planner does not see that ``few`` becomes ``SALTS`` times as long and may
    broadcast it; pass one that grows with the corpus as ``shuffled``."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, [*keys, "salt"]).drop("salt")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character is left as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def words_of(c: Column) -> Column:
    """Array of the whitespace-separated words of a text (null: empty)."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), GAP_RE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` may use it many
    times while it is evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def without(columns: list[str], *taken: str) -> list[str]:
    """The columns that pass through: those whose names, in any case, an
    operator's own columns don't take."""
    return [c for c in columns if c.lower() not in taken]


def row_key(*columns: str) -> Column:
    """Identity of a row from its own values (it survives recomputation): the
    doc_id, and a hash that tells rows of one doc_id apart.  Rows equal in all
    the columns share it."""
    return F.struct(F.col("doc_id"), F.xxhash64(*columns).alias("h"))


def holdout(doc_id: Column, mod: int, rest: int) -> Column:
    """True where crc32 of the decimal document id leaves ``rest`` modulo ``mod``.
    A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))
