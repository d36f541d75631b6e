"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are put in id order in range partitions. Each partition's total is one row
of a small table; the running sum of those totals gives every partition its
offset, and running sums inside the partitions do the rest. A row goes to the
shard in which the middle of its bytes lies when all bytes are cut at equal
targets, so shards are contiguous in that order and differ by less than the
largest row. Only DataFrame operations are used.

Defined results: a null text has no bytes, and its row only the fixed overhead.
Null ids come first. Repeated rows are neighbours and get a slot each; which of
two identical rows gets which slot cannot be told apart. Other columns of the
input do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import written


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Id, size and checksum of every row: all that sharding needs of the texts."""
    return df.select(
        F.col(id_col),
        (text_bytes(F.col(text_col)) + overhead).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )


def byte_shards(rows: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (with ``size``) with ``shard`` and ``slot``, its place in the shard from 0.

    The tables joined back by broadcast have one row for each range partition
    (``spark.sql.shuffle.partitions`` at most) and one for each shard.
    """
    # The last key tells repeated rows apart, so that no id or row, however frequent, has to fit one range.
    order = [F.col(id_col).asc_nulls_first(), *(F.col(c) for c in rows.columns if c != id_col), F.col("_gw_tie")]
    sized_rows = written(rows.withColumn("_gw_tie", F.monotonically_increasing_id()), "shard-sizes")
    ranged = written(sized_rows.repartitionByRange(*order).withColumn("_gw_part", F.spark_partition_id()), "shard-rows")
    totals = ranged.groupBy("_gw_part").agg(F.sum("size").alias("_gw_bytes"), F.count("*").alias("_gw_rows"))
    before = Window.orderBy("_gw_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        "_gw_part",
        F.coalesce(F.sum("_gw_bytes").over(before), F.lit(0)).alias("_gw_byte0"),
        F.coalesce(F.sum("_gw_rows").over(before), F.lit(0)).alias("_gw_row0"),
        F.sum("_gw_bytes").over(everything).alias("_gw_all"),
    )
    inside = Window.partitionBy("_gw_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("_gw_upto", F.sum("size").over(inside))
        .withColumn("_gw_no", F.count("*").over(inside))
        .join(F.broadcast(offsets), "_gw_part")
        # Twice the middle of the row's bytes, as a whole number.
        .withColumn("_gw_mid", 2 * (F.col("_gw_byte0") + F.col("_gw_upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (cast(_gw_mid as decimal(38,0)) * {shards}) div (2 * _gw_all)) as int)"))
        .withColumn("_gw_row", F.col("_gw_row0") + F.col("_gw_no") - 1)
        .select(*rows.columns, "shard", "_gw_row")
    )
    placed = written(placed, "shard-places")
    firsts = placed.groupBy("shard").agg(F.min("_gw_row").alias("_gw_first"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_gw_row") - F.col("_gw_first")).select(*rows.columns, "shard", "slot")
