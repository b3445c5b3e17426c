"""Running sums over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import materialize


def running_sums(df: DataFrame, order: str, sums: list[str], label: str = "prefix") -> DataFrame:
    """df with `<column>_upto` for each of `sums`: the sum over all rows up to this one in `order`.

    `order` is a column of distinct non-null values. The table is cut into as many ranges as the session shuffles
    into, range totals (one row per range) give the offsets, and each range sums within itself.
    """
    cut = materialize(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), label)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = cut.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums]).select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"_{c}")).alias(f"{c}_upto") for c in sums])
