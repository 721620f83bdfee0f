"""Operators under one key that holds most of the rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fernspan.operators import windows


def test_running_sums_of_a_hot_key(spark):
    r = random.Random(1)
    rows = [(i, "hot" if r.random() < 0.9 else r.choice(["a", "b", None]), float(r.randrange(100))) for i in range(4000)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "seq long, k string, v double").repartition(6)
    got = windows.running(d, F.col("k"), "seq", {"total": F.col("v"), "n": F.lit(1)})
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = d.select("*", F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("total"), F.coalesce(F.count("v").over(w), F.lit(0)).alias("n"))
    assert sorted(map(tuple, got.select("seq", "total", "n").collect())) == sorted(map(tuple, want.select("seq", "total", "n").collect()))
    # no window holds the key: its rows lie in several ranges
    dealt = d.repartitionByRange(8, "k", "seq").withColumn("p", F.spark_partition_id())
    assert dealt.filter("k = 'hot'").groupBy("p").count().agg(F.max("count")).first()[0] < 0.4 * 4000
    assert windows.running(d.limit(0), F.col("k"), "seq", {"n": F.lit(1)}).count() == 0


def test_first_of_a_key(spark):
    d = spark.createDataFrame([(3, "a", 1), (1, "a", 0), (2, "a", 1), (4, "b", 0), (5, None, 1), (6, None, 1)], "seq int, k string, m int")
    got = windows.with_first(d, F.col("k"), "seq", {"first": F.lit(True), "marked": F.col("m") == 1}).select("seq", "first", "marked").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, None), (5, 5, 5), (6, 5, 5)]
