"""Numbering all rows in one order without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.sources.shared import written


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``, its place from ``first`` by the columns ``order``, which must tell rows apart.

    Rows are sorted in range partitions; a table with one row for each of those
    gives the partitions their offsets.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_gw_part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_gw_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_gw_part").agg(F.count("*").alias("n")).select("_gw_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_gw_before"))
    place = F.row_number().over(Window.partitionBy("_gw_part").orderBy(*order))
    return ranged.withColumn("_gw_place", place).join(F.broadcast(offsets), "_gw_part").select(*df.columns, (F.col("_gw_before") + F.col("_gw_place") + (first - 1)).alias(name))


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows before by ``order``, by the same two steps."""
    ranged = written(df.repartitionByRange(order).withColumn("_gw_part", F.spark_partition_id()), "running-total")
    rows_before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_gw_part").agg(F.sum(value).alias("n"))
    offsets = offsets.select("_gw_part", F.coalesce(F.sum("n").over(rows_before(Window.orderBy("_gw_part"))), F.lit(0)).alias("_gw_before"))
    inside = F.coalesce(F.sum(value).over(rows_before(Window.partitionBy("_gw_part").orderBy(order))), F.lit(0))
    return ranged.withColumn("_gw_inside", inside).join(F.broadcast(offsets), "_gw_part").select(*df.columns, (F.col("_gw_before") + F.col("_gw_inside")).alias(name))
