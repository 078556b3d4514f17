"""Whole-table running values without a single-task window (§7.5 of the survey).

A window with ORDER BY and no PARTITION BY puts every row into one task.
``global_running`` instead range-partitions the rows on the order key,
checkpoints them (fixed partition ids, lineage cut), computes per-partition
totals and the last row of each partition (one small row per partition), and
broadcasts the offsets back.  The broadcast table has exactly one row per
range partition, a bound fixed by the caller, not by the data.  Inside each
partition an ordinary window does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagsift.session import ensure_checkpoint_dir


def global_running(df: DataFrame, order: Sequence[str], sum_cols: Sequence[str] = (),
                   prev_cols: Sequence[str] = (), num_ranges: int | None = None,
                   with_totals: bool = False, with_rank: bool = False,
                   descending: bool = False) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum), ``prev_<c>`` (previous row's value) in ``order``.

    ``order`` (column names, all ascending or all ``descending``) must be a
    total order (ties make running values arbitrary).
    With ``with_totals`` also ``total_<c>``; with ``with_rank`` a 1-based ``rank``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = list(order)
    sum_cols = list(sum_cols) + (["_one"] if with_rank else [])
    if with_rank:
        df = df.withColumn("_one", F.lit(1))
    order_keys = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    x = df.repartitionByRange(n, *order_keys).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)

    last_by = F.min_by if descending else F.max_by     # the last row of a partition in `order`
    part = x.groupBy("_pid").agg(
        *[F.sum(c).alias(f"_t_{c}") for c in sum_cols],
        *[last_by(F.struct(F.col(c).alias("v")), F.struct(*[F.col(o) for o in order])).alias(f"_l_{c}")
          for c in prev_cols])
    # One row per range partition: the only single-task step, bounded by n.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    allp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offs = part.select(
        "_pid",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
        *[F.lag(f"_l_{c}").over(Window.orderBy("_pid")).alias(f"_c_{c}") for c in prev_cols],
        *([F.sum(f"_t_{c}").over(allp).alias(f"total_{c}") for c in sum_cols] if with_totals else []))

    y = x.join(F.broadcast(offs), "_pid")
    w = Window.partitionBy("_pid").orderBy(*order_keys)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(w) == 1
    cols = [F.col(c) for c in df.columns]
    cols += [(F.sum(c).over(run) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sum_cols]
    cols += [F.when(first, F.col(f"_c_{c}")["v"]).otherwise(F.lag(c).over(w)).alias(f"prev_{c}")
             for c in prev_cols]
    if with_totals:
        cols += [F.col(f"total_{c}") for c in sum_cols]
    out = y.select(*cols)
    if with_rank:
        out = out.withColumnRenamed("cum__one", "rank").drop("_one")
        if with_totals:
            out = out.withColumnRenamed("total__one", "n_rows")
    return out


def ntile_by_rank(rank, n_rows, n: int):
    """WIN-04: contiguous shard of a 1-based rank; the first n_rows % n shards get one more row.

    Same sizes as ``ntile(n)`` without putting all rows in one window.
    """
    rank, n_rows = F.col(rank) if isinstance(rank, str) else rank, F.col(n_rows) if isinstance(n_rows, str) else n_rows
    q = F.floor(n_rows / n)
    r = n_rows % n
    big = r * (q + 1)                       # rows in the larger shards
    return F.when(rank <= big, F.floor((rank - 1) / (q + 1))) \
            .otherwise(r + F.floor((rank - 1 - big) / F.greatest(q, F.lit(1)))).cast("int")
