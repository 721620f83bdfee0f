"""Splits and resampling: whole groups on one side, stratified, repeatable by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(key: Column, buckets: int, seed: int = 42) -> Column:
    """A repeatable bucket from the first 32 bits of md5(seed/key)."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long") % buckets


def group_split(df: DataFrame, group: str, label: str, test_size: float, seed: int = 42) -> DataFrame:
    """Adds ``side``: whole groups go to train or hold, one in round(1 / test_size) within each majority label."""
    k = round(1 / test_size)
    votes = df.groupBy(group, label).agg(F.count("*").alias("n"))
    major = votes.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("__major"))
    # ranks within a stratum by hash: dealt in turn, so that every stratum gives its share
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(group).cast("string")))
    w = Window.partitionBy("__major", "__b").orderBy(order, group)
    dealt = major.withColumn("__b", bucket(F.col(group), 64, seed)).withColumn("__r", F.row_number().over(w))
    side = F.when((F.col("__r") + F.col("__b")) % k == 0, "hold").otherwise("train")
    return df.join(dealt.select(group, side.alias("side")), group)


def random_split(df: DataFrame, key: str, label: str, test_size: float, seed: int = 42) -> DataFrame:
    """Ungrouped, stratified: about one row in round(1 / test_size) of each label, by hash of (label, key)."""
    k = round(1 / test_size)
    return df.withColumn("side", F.when(bucket(F.concat_ws("/", label, F.col(key).cast("string")), k, seed) == 0, "hold").otherwise("train"))


def pinned(df: DataFrame, source: Column, synthetic: list[str], shift: list[str]) -> DataFrame:
    """Synthetic sources only ever train, one source is the shift set, the rest is the pool."""
    return df.withColumn("role", F.when(source.isin(*shift), "shift").when(source.isin(*synthetic), "synthetic").otherwise("pool"))


def without_leaks(rows: DataFrame, held: DataFrame, on: str) -> DataFrame:
    """Rows whose key doesn't occur among the held-out ones."""
    return rows.join(held.select(on).distinct(), on, "left_anti")


def folds(df: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", bucket(F.col(group), k, seed).cast("int"))
