"""Ordered functions on groups that lie in many ranges: one case with a third of all rows and more."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from packetloom.operators import ordered
from packetloom.session import materialize, release


@pytest.fixture
def rows(spark):
    rnd = random.Random(4)
    data = [("hot" if i % 3 == 0 else f"k{rnd.randrange(90)}", rnd.choice([None, *range(50)]), i, rnd.uniform(-3, 3)) for i in range(900)]
    return spark.createDataFrame(data, "key string, at int, id int, x double")


@pytest.mark.parametrize("k", [1, 3, 200])
def test_previous_rows_come_along(spark, rows, k):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = ordered.with_previous(rows, "key", ["at", "id"], k, "t")
        assert cut.where("key = 'hot'").select("_part").distinct().count() > 3
        frame = lambda *keys: Window.partitionBy(*keys).orderBy("at", "id").rowsBetween(-k, 0)
        got = cut.withColumn("s", F.sum("x").over(frame("_part", "key"))).where("NOT _context")
        want = rows.withColumn("s", F.sum("x").over(frame("key")))
        assert {r.id: round(r.s, 6) for r in got.collect()} == {r.id: round(r.s, 6) for r in want.collect()} and got.count() == 900
        run = ordered.running(ordered.parted(rows, "key", ["at", "id"], "t"), "key", ["at", "id"], {"s": F.col("x")})
        w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
        plain = rows.withColumn("s", F.sum("x").over(w)).withColumn("lo", F.min("s").over(w)).withColumn("hi", F.max("s").over(w))
        assert {r.id: tuple(round(v, 6) for v in (r.s, r.s_least, r.s_most)) for r in run.collect()} == {r.id: tuple(round(v, 6) for v in (r.s, r.lo, r.hi)) for r in plain.collect()}
        assert ordered.with_previous(rows.limit(0), "key", ["at", "id"], k, "t").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_intermediate_tables_can_be_released(spark, rows):
    kept = materialize(rows, "t")
    assert kept.count() == 900
    release(spark)
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|FILE_NOT_EXIST"):
        kept.select(F.sum("x")).collect()
