"""Places of rows in an order, without a task that sorts them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, *order: Column | str, cut: Callable[[DataFrame], DataFrame], name: str = "place") -> DataFrame:
    """rows with their place, from 0, in an order without ties: dealt into ranges, which are counted, then numbered within each. cut: what holds the dealt rows."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    first = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(first), "_range").select(*rows.columns, (F.col("_first") + F.col("_own") - 1).alias(name))
