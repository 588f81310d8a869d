"""Pieces shared by the operators of this subpackage.

Internal columns start with ``__`` so that they cannot clash with the columns
of a caller's table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ASCII white space of the word rule [^\x20\x09-\x0D]+.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A bucket of a seeded order is meant to hold about this many rows.
ROWS_PER_BUCKET = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column, separator: str = SPACE_CLASS) -> Column:
    """Words of a text, as array<string>; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), separator)
    # Only the first and the last part can be empty.
    return F.filter(parts, lambda w: w != F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(text, UPPER, LOWER)


def seeded_hash(seed: str, *cols: Column) -> Column:
    """60 bits of md5 as a long in 0 .. 2^60 - 1.  md5 rather than xxhash64 so
    that plain SQL on another engine can repeat the order."""
    parts = [F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols]
    digest = F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A never-null string standing for a source (null is a source of its own)."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def bucket_bits(n_rows: int) -> int:
    """Bits of a bucket number so that a group of all ``n_rows`` rows is split
    into buckets of about ``ROWS_PER_BUCKET`` rows (at most 2^22 buckets)."""
    return max(1, min(22, math.ceil(math.log2(max(2, n_rows) / ROWS_PER_BUCKET)) if n_rows > ROWS_PER_BUCKET else 1))


def running(df: DataFrame, group: str | None, bucket: str, order: list[str], value: str, bits_name: str = "") -> DataFrame:
    """Rank and running total inside each group, without putting a group into one task.

    ``bucket`` is a coarse version of the first order column, so that all rows
    of a lower bucket come first.  Adds ``__rank`` (0-based), ``__before`` (sum
    of ``value`` over the rows before), ``__n`` and ``__total`` of the group.
    Bucket sums are one row per group and bucket (partial aggregation); only
    they pass through the prefix window.  Rows are shuffled once, by
    (group, bucket).
    """
    keys = ([group] if group else []) + [bucket]
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__bn"), F.sum(value).alias("__bv"))
    whole = Window.partitionBy(*([group] if group else []))
    ahead = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *keys,
        F.coalesce(F.sum("__bn").over(ahead), F.lit(0)).alias("__rank0"),
        F.coalesce(F.sum("__bv").over(ahead), F.lit(0)).alias("__before0"),
        F.sum("__bn").over(whole).alias("__n"),
        F.sum("__bv").over(whole).alias("__total"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    out = df.join(sums, keys)
    out = out.withColumn("__r", F.row_number().over(inside))
    out = out.withColumn("__v", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return (out.withColumn("__rank", F.col("__rank0") + F.col("__r") - 1)
               .withColumn("__before", F.col("__before0") + F.col("__v") - F.col(value))
               .drop("__rank0", "__before0", "__r", "__v"))


# Keys of at least one in so many rows are broadcast, so there are at most so many of them.
HOT_SHARE = 1000


def join_by_weight(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of ``rows`` to a written ``table`` with one row per string ``key``, where
    ``weight`` says how many rows hold it.  A key of more than a thousandth of all
    rows is looked up in a broadcast of at most ``HOT_SHARE`` such keys; the other
    keys are joined by shuffle, where none is more than a thousandth."""
    names = [c for c in table.columns if c != key]
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    packed = F.struct(*names)
    many = table.filter(hot).select(F.col(key).alias("__hot_key"), packed.alias("__hot"))
    few = table.filter(~hot).select(F.col(key).alias("__cold_key"), packed.alias("__cold"))
    out = rows.join(F.broadcast(many), F.col(key) == F.col("__hot_key"), "left")
    # Rows that are served spread over all partitions under keys that nothing has.
    out = out.withColumn("__at", F.when(F.col("__hot_key").isNull(), F.col(key)).otherwise(
        F.concat(F.lit("~"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("string"))))
    out = out.join(few, F.col("__at") == F.col("__cold_key"), "left")
    got = F.coalesce("__hot", "__cold")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[got[n].alias(n) for n in names])
