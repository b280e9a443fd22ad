"""Exact running sums over a global order, from per-partition totals, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, task_count


def running_totals(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """``rows`` with ``at`` (its place from 0), ``before`` (the sizes ahead of it) and ``total``.

    The rows are range-partitioned and sorted by ``order`` once; each partition's row count and
    size are summed (one row per partition, the only thing that meets in one place and is
    broadcast), and a window inside each partition does the rest. No window spans partitions.
    The sorted rows are written to the checkpoint folder, so a lost executor can't change the
    places that others have already used.
    """
    spark = rows.sparkSession
    parts = max(2 * task_count(spark), 2)
    placed = cut(
        rows.repartitionByRange(parts, *[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    every = Window.orderBy("_part")
    totals = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"), F.sum(size).alias("_size"))
        .select(
            "_part",
            F.coalesce(F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_size").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_size_before"),
            F.sum("_size").over(Window.partitionBy()).alias("total"),
        )
    )
    inside = Window.partitionBy("_part").orderBy("_id")
    return (
        placed.withColumn("_in", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(F.broadcast(totals), "_part")  # at most `parts` rows
        .withColumn("at", F.col("_rows_before") + F.expr("_id & 8589934591"))
        .withColumn("before", F.col("_size_before") + F.col("_in"))
        .drop("_id", "_part", "_in", "_rows_before", "_size_before")
    )
