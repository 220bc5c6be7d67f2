"""The N best items of every group, however large a group is.

Exact group counts split the groups.  A *heavy* group holds more than its share
of all rows; its rows are range-sorted over many partitions, each range (the
salt) keeps its own first N, and only those meet in one window.  The others
take an ordinary window, below which Spark keeps N rows per task before the
shuffle.  Both results are united.

Defined results: null groups, null items and null or NaN scores are ignored;
an item returned more than once counts once with its highest score; equal
scores are ordered by the item ascending; fewer than N items give what there
is; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    rows: DataFrame,
    n: int,
    group: str = "query_id",
    item: str = "page_id",
    score: str = "score",
    heavy_share: int = 100,
) -> DataFrame:
    """``group, item, score, rank`` of the first ``n`` items of each group.

    A group is heavy with more than 1/``heavy_share`` of all rows, at every
    size, so there are fewer than ``heavy_share`` heavy groups: that bounds the
    key list which is broadcast.
    """
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("n must be a positive integer")
    valid = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s")).where(
        F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s")
    )
    best = valid.groupBy("g", "i").agg(F.max("s").alias("s"))
    counts = valid.groupBy("g").count()
    total = counts.agg(F.sum("count").alias("total"))
    heavy_keys = [r["g"] for r in counts.join(F.broadcast(total), F.col("count") * heavy_share > F.col("total")).select("g").collect()]

    order = [F.col("s").desc(), F.col("i").asc()]
    light, ranked = best, []
    if heavy_keys:
        assert len(heavy_keys) < heavy_share
        keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in heavy_keys], best.select("g").schema))
        light = best.join(keys, "g", "left_anti")
        ranges = (
            best.join(keys, "g", "left_semi").repartitionByRange("g", *order).withColumn("salt", F.spark_partition_id())
        )
        per_range = Window.partitionBy("g", "salt").orderBy(*order)
        firsts = ranges.withColumn("rank", F.row_number().over(per_range)).where(F.col("rank") <= n).drop("rank", "salt")
        ranked.append(firsts)
    ranked.append(light)
    whole = Window.partitionBy("g").orderBy(*order)
    parts = [p.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n) for p in ranked]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
