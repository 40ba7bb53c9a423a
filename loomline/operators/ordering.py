"""Predecessors in an order of unbounded groups, without a window that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import stage


def previous(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with `name`: value of the row before it in its group, null for the first row of a group.

    Rows are range-partitioned by group and order, so a group that holds a third of all rows is spread over many tasks; windows only see the rows of one
    partition. The last row of each (partition, group) is handed on to the group's next partition through a small second pass (groups + partitions rows).
    Nulls in group or order sort first and count as equal; ties are broken by the order columns given, which should be unique.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    part = stage(df.withColumn("_v", value).repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_g{i}") for i, c in enumerate(group)]
    names = [f"_g{i}" for i in range(len(group))]
    part = part.select("*", *keys)
    w = Window.partitionBy(*names, "_pid").orderBy(*order)
    lasts = part.groupBy(*names, "_pid").agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*names).orderBy("_pid")
    handed = lasts.select(*names, "_pid", F.lag("_last").over(across).alias("_hand"))
    rows = part.withColumn("_lag", F.lag("_v").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    out = rows.join(handed, [*names, "_pid"], "left")
    return out.withColumn(name, F.when(F.col("_first"), F.col("_hand")).otherwise(F.col("_lag"))).drop("_v", "_pid", "_lag", "_first", "_hand", *names)


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """df with `name`: the 0-based position of each row in its group, in ascending order; order should be unique within a group.

    As in previous(), rows are range-partitioned; the number of rows that a group has in earlier partitions is added to the position within the partition.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    part = stage(df.repartitionByRange(n, group, order).withColumn("_pid", F.spark_partition_id()))
    counts = part.groupBy(group, "_pid").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(group, "_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(group, "_pid").orderBy(order)
    rows = part.withColumn("_at", F.row_number().over(within) - 1).join(offset, [group, "_pid"])
    return rows.withColumn(name, F.col("_at") + F.col("_off")).drop("_at", "_off", "_pid")
