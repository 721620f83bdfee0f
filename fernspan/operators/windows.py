"""Running values over keys of which one may hold most of the rows.

A window over a key sorts all of the key's rows in one task.  Here a key's rows are cut into ranges by their order: ranges of rows have
windows of their own, totals of ranges (one row each) have a small window over the key, and what it carries is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernspan.session import keep


def running(df: DataFrame, key: Column, order: str, sums: dict[str, Column]) -> DataFrame:
    """Adds sums over the earlier rows of the same key (0 for the first one); order is a column without repeats within a key.

    Rows are dealt by ranges of (key, order) and written once, so that every later step sees the same ranges; a task's rows, and so a
    window's, are a share of all rows whatever the keys. Columns that begin with two underscores and a name given here are
    overwritten.
    """
    given = df.columns
    d = df.withColumn("__key", key).withColumns({f"__own_{n}": c for n, c in sums.items()})
    d = keep(d.repartitionByRange("__key", order).withColumn("__range", F.spark_partition_id()), "running")
    totals = d.groupBy("__key", "__range").agg(*(F.sum(f"__own_{n}").alias(n) for n in sums))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("__key").alias("__k"), F.col("__range").alias("__r"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__carry_{n}") for n in sums))
    inside = Window.partitionBy("__key", "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"__in_{n}": F.coalesce(F.sum(f"__own_{n}").over(inside), F.lit(0)) for n in sums})
    d = d.join(carry, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__range") == F.col("__r")))
    return d.select(*(c for c in given if c not in sums), *((F.col(f"__carry_{n}") + F.col(f"__in_{n}")).alias(n) for n in sums))


def trailing(df: DataFrame, key: str, order: str, span: int, value: str) -> DataFrame:
    """(key, order, rows, n, total): for every order of a key its rows, and the number and sum of the key's values from span before it up to it.

    A value comes at its order and goes behind its span, so what a window holds is a running sum, and a row costs the same however many rows
    a window has. Sums are of decimals, so what came goes without a rest; total is null for n = 0. Rows without an order see each other only.
    Infinite values are right from below only; an infinite or missing number at the top is an error.
    """
    low = F.coalesce(F.col(value) == float("-inf"), F.lit(False))
    one = F.col(value).isNotNull().cast("long")
    exact = F.coalesce(F.when(~low, F.col(value)).cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))
    event = lambda at, rows, sign: F.struct(at.alias(order), F.lit(rows).cast("long").alias("rows"), (one * sign).alias("n"), F.when(F.lit(sign > 0), exact).otherwise(-exact).alias("total"), (low.cast("long") * sign).alias("low"))
    come, gone = event(F.col(order), 1, 1), event(F.col(order) + span + 1, 0, -1)
    both = F.when(F.col(order).isNull() | F.col(value).isNull(), F.array(come)).otherwise(F.array(come, gone))
    d = df.select(key, F.explode(both).alias("e")).groupBy(key, F.col(f"e.{order}").alias(order)).agg(*(F.sum(f"e.{c}").alias(c) for c in ("rows", "n", "total", "low")))
    d = d.withColumn("__none", F.col(order).isNull())
    d = running(d, F.struct(key, "__none"), order, {f"__before_{c}": F.col(c) for c in ("n", "total", "low")}).filter("rows > 0")
    n, total, least = (F.col(f"__before_{c}") + F.col(c) for c in ("n", "total", "low"))
    return d.select(key, order, "rows", n.alias("n"), F.when(least > 0, float("-inf")).when(n > 0, total.cast("double")).alias("total"))


def with_first(df: DataFrame, key: Column, order: str, marks: dict[str, Column]) -> DataFrame:
    """Adds, for each mark, the least order of the key's rows that have it (null if none has): what tells a row that one before it had the mark.

    An aggregate, combined before the exchange, and a join; AQE splits a hot key's rows in it.
    """
    d = df.withColumn("__key", key)
    least = d.groupBy(F.col("__key").alias("__k")).agg(*(F.min(F.when(c, F.col(order))).alias(n) for n, c in marks.items()))
    return d.join(least, F.col("__key").eqNullSafe(F.col("__k")), "left").drop("__key", "__k")
