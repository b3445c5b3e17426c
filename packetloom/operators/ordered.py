"""Ordered functions per group that do not put a group into one task.

The table is cut into ranges of (key, order), so a group of any share of the rows lies in as many
ranges as it needs. What a row needs from rows before it comes along: either the last few rows of the
ranges before (`with_previous`), or totals of the ranges before (`running`). All groups go the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import materialize


def parted(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """df, written, with `_part`: the number of its range of (key, order)."""
    return materialize(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), label)


def with_previous(df: DataFrame, key: str, order: list[str], k: int, label: str) -> DataFrame:
    """df with `_part` and `_context`: within (_part, key) every row has the k rows before it in its group, as far as there are any.

    Rows of `_context` only serve windows and are to be dropped after them. At most k rows per range are
    copied; `order` must tell all rows of a group apart. `key` has no nulls.
    """
    cut = parted(df, key, order, label)
    columns = df.columns
    # only the last key of a range can go on in the next ones, only the first of a range can have begun before
    bounds = cut.groupBy("_part").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    begun = bounds.select("_part", F.col("_low").alias(key))
    ended = bounds.select("_part", F.col("_high").alias(key))
    backwards = Window.partitionBy("_part", key).orderBy(*[F.desc(c) for c in order])
    tails = cut.join(ended, ["_part", key]).withColumn("_n", F.row_number().over(backwards)).where(F.col("_n") <= k)
    # tails of one key in their order; a range needs the last k of those of the ranges before it
    in_order = Window.partitionBy(key).orderBy("_part", F.desc("_n"))
    tails = tails.withColumn("_i", F.row_number().over(in_order)).withColumn("_bucket", F.floor((F.col("_i") - 1) / k))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = tails.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_tails"))
    base = begun.join(counted, ["_part", key], "full").select("_part", key, F.coalesce(F.sum("_tails").over(before), F.lit(0)).alias("_base")).where("_base > 0")
    last = F.floor((F.col("_base") - 1) / k)
    asked = base.select(F.col("_part").alias("_to"), key, "_base", F.explode(F.array(last, last - 1)).alias("_bucket"))
    given = asked.join(tails, [key, "_bucket"]).where((F.col("_i") <= F.col("_base")) & (F.col("_i") > F.col("_base") - k))
    context = given.select(*columns, F.col("_to").alias("_part"), F.lit(True).alias("_context"))
    return cut.withColumn("_context", F.lit(False)).unionByName(context)


def running(cut: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """cut (of `parted`) with, for each of `sums`, `<name>`, `<name>_least` and `<name>_most`: the running sum of its group, and the least and greatest of its running sums so far."""
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = list(sums)
    local = cut.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    local = local.select("*", *[f(n).over(inside).alias(f"{n}_{end}") for n in names for f, end in ((F.min, "least"), (F.max, "most"))])
    totals = cut.groupBy("_part", key).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    ends = local.groupBy("_part", key).agg(*[f(n).alias(f"_{end}_{n}") for n in names for f, end in ((F.min, "least"), (F.max, "most"))])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", key, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_o_{n}") for n in names])
    extremes = ends.join(offsets, ["_part", key]).select(
        "_part", key, *[f"_o_{n}" for n in names],
        *[f(F.col(f"_o_{n}") + F.col(f"_{end}_{n}")).over(before).alias(f"_p_{end}_{n}") for n in names for f, end in ((F.min, "least"), (F.max, "most"))],
    )
    joined = local.join(extremes, ["_part", key])
    out = {}
    for n in names:
        out[n] = F.col(n) + F.col(f"_o_{n}")
        out[f"{n}_least"] = F.least(F.col(f"{n}_least") + F.col(f"_o_{n}"), F.col(f"_p_least_{n}"))
        out[f"{n}_most"] = F.greatest(F.col(f"{n}_most") + F.col(f"_o_{n}"), F.col(f"_p_most_{n}"))
    return joined.select(*cut.columns, *[c.alias(n) for n, c in out.items()])
