"""Exact places in a sorted order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import checkpoint


def range_numbers(rows: DataFrame, order: list[Column], name: str, within: str | None = None) -> DataFrame:
    """``rows`` with their 0-based place in ``order``, counted anew for each value of ``within`` if given.

    Rows are range-sorted over partitions and fixed there by a checkpoint, so
    that numbering and counting see the same ranges; a range's rows are numbered
    by themselves, and the sizes of the ranges before it, one small row each,
    are added.
    """
    keys = [within] if within else []
    ranged = checkpoint(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    numbered = ranged.withColumn(name, F.row_number().over(local) - 1)
    sizes = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return numbered.join(offsets, ["_part", *keys]).withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset")
