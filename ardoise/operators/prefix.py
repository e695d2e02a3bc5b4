"""Rank and running sum over a total order of the whole table, without one task holding it.

A window without partition columns sends every row to one task.  Here the rows are range-partitioned
by the order, each partition ranks and sums its own, and the partitions' totals -- one row each --
give the offset at which each begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ardoise.session import materialise


def ranked(df: DataFrame, order: list[Column], value: str | None = None) -> DataFrame:
    """Adds ``rang`` (1 for the first row) and, with ``value``, ``cumul`` (its sum up to and with the row).

    ``order`` must be a total order for the result to be unique.  Null values add nothing.  An empty
    table gives no row.
    """
    # Written once: the bounds of the ranges are sampled, and must not be drawn anew between the two reads.
    x = materialise(df.repartitionByRange(*order).withColumn("_partie", F.spark_partition_id()), "rangs")
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(value).alias("_s")] if value else [])
    w = Window.orderBy("_partie").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = x.groupBy("_partie").agg(*sums)
    offsets = totals.select("_partie", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_avant"), *([F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_somme")] if value else []))
    own = Window.partitionBy("_partie").orderBy(*order)
    y = x.join(F.broadcast(offsets), "_partie").withColumn("rang", F.row_number().over(own) + F.col("_avant"))
    if value:
        y = y.withColumn("cumul", F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.col("_somme"))
    return y.drop("_partie", "_avant", "_somme")
