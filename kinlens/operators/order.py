"""Row numbers over a whole table without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def numbered(df: DataFrame, order: list[Column], start: int, name: str) -> DataFrame:
    """Rows numbered from ``start`` in an order, without one task for all: range partitions count their own, and get an offset."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = cut.groupBy("_part").count()  # one row a partition
    offsets = counts.select("_part", (F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start).alias("_from"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return cut.withColumn("_in", inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_from") + F.col("_in")).drop("_part", "_in", "_from")
