"""Ranks over whole tables, without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import cut_lineage


def placed(rows: DataFrame, name: str, *order: Column, ties: bool = False) -> DataFrame:
    """The rows with their place from 1 by `order`, as row numbers or, with `ties`, as ranks.

    Rows are dealt into ranges of the order, so equal ones are in one range; each range is numbered by itself
    from the number of rows before it, a prefix sum over as many rows as there are ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(rows.repartitionByRange(max(1, parts), *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_base"))
    own = Window.partitionBy("_range").orderBy(*order)
    place = F.col("_base") + (F.rank() if ties else F.row_number()).over(own)
    return dealt.join(F.broadcast(bases), "_range").withColumn(name, place.cast("int")).drop("_range", "_base")
