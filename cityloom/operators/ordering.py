"""Global numbering and running totals without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityloom.session import stored


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with 1, 2, ... in the given order: ranges are numbered within, their sizes summed before them."""
    ranged = stored(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_i", inside).join(before, "_part").withColumn(out, F.col("_before") + F.col("_i")).drop("_part", "_i", "_before")
