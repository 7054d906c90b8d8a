"""Whole-table ranks without a one-task window."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docsift.session import checkpointed


def hash_key(seed, *cols) -> Column:
    """Reproducible pseudo-random order of rows: md5 of the seed and the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_uniform(seed, *cols) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of the md5 key."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_rank(df: DataFrame, key: str, seed, out: str = "rank", digits: int = 3) -> DataFrame:
    """0-based rank of each row in md5 order.

    md5 spreads any key evenly over 16**digits buckets, so each window below sorts
    1/4096 of the table whatever the data looks like. The table of bucket sizes has at
    most 16**digits rows, hence the broadcast.
    """
    return _hash_rank(df, key, seed, out, digits, F.lit(True))


def first_keys(df: DataFrame, key: str, seed, n: int, digits: int = 3) -> DataFrame:
    """The first n keys in md5 order; buckets beyond the cut are dropped before anything is sorted."""
    ranked = _hash_rank(df.select(key), key, seed, "_rank", digits, F.col("_start") < n)
    return ranked.where(F.col("_rank") < n).select(key)


def _hash_rank(df, key, seed, out, digits, wanted) -> DataFrame:
    keyed = df.withColumn("_h", hash_key(seed, key)).withColumn("_b", F.substring("_h", 1, digits))
    sizes = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")).where(wanted)
    within = F.row_number().over(W.partitionBy("_b").orderBy("_h", key)) - 1
    return (
        keyed.join(F.broadcast(starts), "_b")
        .withColumn(out, (F.col("_start") + within).cast("long"))
        .drop("_h", "_b", "_start")
    )


def range_slices(df: DataFrame, order: list, slices: int | None = None) -> DataFrame:
    """Rows in global order, cut in even slices: adds `_slice` and `_pos` (position in it).

    The range exchange splits on the full order key, so one hot group spreads over many
    slices. The checkpoint fixes the slices: a lost task cannot resample other bounds.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    marked = ordered.withColumn("_m", F.monotonically_increasing_id())
    fixed = checkpointed(marked)
    return (
        fixed.withColumn("_slice", F.shiftright("_m", 33))
        .withColumn("_pos", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_m")
    )


def order_rank(df: DataFrame, order: list, out: str = "rank", slices: int | None = None) -> DataFrame:
    """0-based rank in the given global order; the order key must be unique."""
    cut = range_slices(df, order, slices)
    sizes = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row per slice
    return (
        cut.join(F.broadcast(starts), "_slice")
        .withColumn(out, (F.col("_start") + F.col("_pos")).cast("long"))
        .drop("_slice", "_pos", "_start")
    )
