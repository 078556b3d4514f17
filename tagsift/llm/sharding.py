"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair draws a uniform number u from a hash; the record goes to the shard with the
smallest ``-ln(u) / weight`` (ties: the lower shard).  The key and the shard list alone decide, so
a new shard takes rows only into itself: all other draws stay as they were.

All of it is one expression per row without a shuffle.  Only the slot numbers need one: rows are
ranked inside (shard, slice), where a slice is a hash range of the key, so that a shard is numbered
by ``slices`` tasks rather than by one; the slice offsets are one row per (shard, slice), a number
that the parameters fix.

Cases: a null key is hashed as the text "null"; a null text has no bytes and the CRC of the empty
string; repeated rows share their shard and get different slots; an empty table gives no rows.
Only the key and text columns are read, so other columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _draw(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * (2.0 ** -53)
    return -F.log(u) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(draw, shard) of the winning shard; weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    draws = [F.struct(_draw(key, i, float(w)).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.least(*draws) if len(draws) > 1 else draws[0]


def assign_shards(df: DataFrame, key: str, text: str, weights: Sequence[float],
                  new_weight: float = 1.0, overhead: int = 16, slices: int = 64) -> DataFrame:
    """Columns ``key``, size, text_crc32, shard, grown_shard (with one more shard of ``new_weight``), slot."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    n = len(weights)
    won = rendezvous(k, weights)
    slice_no = F.pmod(F.xxhash64(F.lit("slot"), k), F.lit(slices)).cast("int")
    placed = df.select(
        F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_n"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        won.alias("_won"), _draw(k, n, float(new_weight)).alias("_new"), slice_no.alias("_slice"))
    placed = placed.select(
        F.col(key), (F.col("_n") + overhead).alias("size"), "text_crc32", F.col("_won.shard").alias("shard"),
        F.when(F.col("_new") < F.col("_won.draw"), F.lit(n)).otherwise(F.col("_won.shard")).alias("grown_shard"),
        "_slice")
    # At most len(weights) * slices rows: small enough to broadcast whatever the table's size.
    counts = placed.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "_slice").orderBy(key, "size", "text_crc32"))
    return (placed.withColumn("_rank", rank).join(F.broadcast(offsets), ["shard", "_slice"])
            .select(key, "size", "text_crc32", "shard", "grown_shard",
                    (F.col("_offset") + F.col("_rank") - 1).cast("long").alias("slot")))
