"""Row numbers over a whole table without ordering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import cut_lineage


def nested_row_number(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``row_number()`` over ``columns``, counted level by level.

    Each level only orders the distinct values below one parent (the calendar, then the
    stores of a day, then the families of a store-day), so no window spans the table.
    """
    before: DataFrame | None = None
    for depth in range(1, len(columns)):
        path = columns[:depth]
        sizes = df.groupBy(*path).agg(F.count(F.lit(1)).alias("_n"))
        parent = Window.partitionBy(*path[:-1]) if path[:-1] else Window.partitionBy(F.lit(0))
        order = parent.orderBy(path[-1]).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_skip", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        if before is not None:
            sizes = sizes.join(before, path[:-1]).withColumn("_skip", F.col("_skip") + F.col("_base"))
        before = sizes.select(*path, F.col("_skip").alias("_base"))
    leaf = Window.partitionBy(*columns[:-1]) if columns[:-1] else Window.partitionBy(F.lit(0))
    numbered = df.withColumn("_rn", F.row_number().over(leaf.orderBy(columns[-1])))
    if before is None:
        return numbered.withColumnRenamed("_rn", name)
    return (
        numbered.join(before, columns[:-1])
        .withColumn(name, (F.col("_base") + F.col("_rn")).cast("long"))
        .drop("_rn", "_base")
    )


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``row_number()`` over a whole table: range partitions, their sizes, and one offset per partition.

    Rows of equal order values lie in one partition. The partitioned rows are checkpointed once, because the numbers are
    only right if sizes and rows come from the same partitions. The window over sizes has one row per partition.
    """
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_rn", within).join(offsets, "_part").select(
        *df.columns, (F.col("_base") + F.col("_rn")).alias(name))
