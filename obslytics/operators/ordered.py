"""Skew-safe ordered operators: row number and previous value within a key.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to
one task, and ``Window.orderBy(ts)`` sends the whole table to one task.  Here
the window runs within (key, bucket), where the bucket is a pure function of
the order column that keeps its order: the minute of a time, the first hex
digits of a hash.  A key that holds a third of all rows is so spread over its
buckets.  A partial aggregate over the same buckets (one row per key and
bucket) supplies the offset and the value carried over from the buckets before.

The rows are shuffled once; there is no sampling pass and no checkpoint, and a
bucket is the same whenever a lost task is run again.  The running sums over a
key's buckets meet in one task: 525,600 rows for a year of minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(col: str) -> Column:
    return F.date_trunc("minute", F.col(col))


def hash_bucket(col: str) -> Column:
    """Of a hexadecimal hash: 4096 buckets."""
    return F.substring(col, 1, 3)


NULL_BUCKETS = 256


def ordered_index(df: DataFrame, keys: list[str], order: str, tie: str | None = None, rn_col: str = "rn",
                  prev_col: str | None = "prev", size_col: str | None = None, bucket=time_bucket) -> DataFrame:
    """Add ``rn_col`` (1-based position within ``keys`` ordered by ``order``, ``tie``),
    ``prev_col`` (the ``order`` value of the preceding row, NULL for the first)
    and optionally ``size_col`` (rows in the row's key group).  Rows whose order value is NULL come first, by a hash of the tie.  ``bucket`` maps the
    name of the order column to a column that never decreases with it.
    """
    # structs compare with NULL fields equal, so rows with a NULL key or time form groups too; those without a time,
    # which no bucket tells apart, are dealt by a hash of the tie
    spread = F.when(F.col(order).isNull(), F.pmod(F.xxhash64(tie), F.lit(NULL_BUCKETS))).otherwise(0) if tie else F.lit(0)
    group = F.struct(F.struct(F.lit(0), *keys).alias("key"), bucket(order).alias("bucket"), spread.cast("int").alias("spread"))
    rows = df.withColumn("_g", group)
    local = Window.partitionBy("_g").orderBy(order, *([tie] if tie else []))
    rows = rows.withColumn("_lrn", F.row_number().over(local))
    if prev_col:
        rows = rows.withColumn("_lprev", F.lag(order).over(local))
    bounds = (df.select(group.alias("_g"), F.col(order).alias("_o")).groupBy("_g")
                .agg(F.count(F.lit(1)).alias("_cnt"), F.max("_o").alias("_lmax")))
    by_key = Window.partitionBy(F.col("_g.key")).orderBy(F.col("_g.bucket"), F.col("_g.spread"))
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_offset")]
    if prev_col:
        extra.append(F.max("_lmax").over(before).alias("_carry"))
    if size_col:
        extra.append(F.sum("_cnt").over(Window.partitionBy(F.col("_g.key"))).alias(size_col))
    out = rows.join(bounds.select("_g", *extra), "_g").withColumn(rn_col, F.col("_lrn") + F.col("_offset"))
    if prev_col:
        out = out.withColumn(prev_col, F.coalesce("_lprev", "_carry"))
    return out.drop("_g", "_lrn", "_lprev", "_offset", "_carry")


def minutes_between(later, earlier):
    """Difference of two timestamps in minutes, exact to the microsecond."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)
