"""Exact quantiles by distributed selection: successive histograms narrow the interval that holds a rank, group by group.

A group of any size is never in one task.  A pass counts values of the interval in ``BINS`` equal parts, with the least and the largest value of each
part; partial aggregation leaves at most that many rows a task and interval.  The part that holds the rank is the next
interval, from its least to its largest value, so every pass makes it shorter, whatever the values; it ends at one value, or when ``FEW`` values are
left, which are fetched and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernspan.session import Kept, fits_broadcast, keep

BINS = 256
#: Values that are fetched and sorted for an interval, at most.
FEW = 1000
#: Bytes of an interval in a broadcast.
INTERVAL_BYTES = 96


def _ranks(sizes: DataFrame, shares: list[float]) -> DataFrame:
    """(k, share, rank, part): the two ranks that a quantile lies between, and how far it is from the first."""
    s = sizes.select("k", "n", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    pos = F.col("share") * (F.col("n") - 1)
    low = F.floor(pos)
    return s.select("k", "n", "share", low.alias("low"), F.least(low + 1, F.col("n") - 1).alias("high"), (pos - low).alias("part"))


def order_statistics(values: DataFrame, wanted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(k, rank, v): the values of the given ranks (from 0) of each group. values: k, v; wanted: k, rank; sizes: k, n, lo, hi."""
    w = wanted.distinct().select(F.col("k").alias("k2"), "rank")
    at = Kept(w.join(sizes, F.col("k2").eqNullSafe(F.col("k"))).select("k", "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), "ranks")
    done: list[DataFrame] = []
    while True:
        done.append(at.df.filter("lo = hi").select("k", "rank", F.col("lo").alias("v")))
        open_ = at.df.filter("lo < hi")
        spans = open_.select(F.col("k").alias("k2"), "lo", "hi", "inside").distinct()
        most = spans.agg(F.count("*").alias("n"), F.max("inside").alias("m")).first()
        if not most["n"]:
            break
        side = F.broadcast(spans) if fits_broadcast(most["n"], INTERVAL_BYTES) else spans
        found = values.join(side, F.col("k").eqNullSafe(F.col("k2")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
        if most["m"] <= FEW:
            lists = found.groupBy("k2", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("vs")).select("k2", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "vs")
            done.append(open_.join(lists, same("k", "k2") & (F.col("lo") == F.col("lo2")) & (F.col("hi") == F.col("hi2"))).select("k", "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v")))
            break
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
        cells = found.groupBy("k2", "lo", "hi", part.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
        upto = F.sum("c").over(Window.partitionBy("k2", "lo", "hi").orderBy("bin"))
        cells = cells.select("k2", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "c", "new_lo", "new_hi", (upto - F.col("c")).alias("before"))
        hit = (F.col("rank") >= F.col("below") + F.col("before")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("c"))
        nxt = open_.join(cells, same("k", "k2") & (F.col("lo") == F.col("lo2")) & (F.col("hi") == F.col("hi2")) & hit)
        at = Kept(nxt.select("k", "rank", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("inside")), "ranks")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def quantiles(df: DataFrame, key: Column, value: Column, shares: list[float]) -> DataFrame:
    """(k, share, q): interpolated between the two nearest values, as percentile does; null and NaN don't count, groups without values are left out."""
    v = value.cast("double")
    values = df.select(key.alias("k"), v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = keep(values.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    r = keep(_ranks(sizes, shares), "wanted")
    found = keep(order_statistics(values, r.select("k", F.col("low").alias("rank")).unionByName(r.select("k", F.col("high").alias("rank"))), sizes), "statistics")
    out = r.withColumnRenamed("k", "kr")
    for side in ("low", "high"):
        f = found.select(F.col("k").alias("ks"), F.col("rank").alias("rs"), F.col("v").alias(f"v_{side}"))
        out = out.join(f, F.col("kr").eqNullSafe(F.col("ks")) & (F.col(side) == F.col("rs"))).drop("ks", "rs")
    return out.select(F.col("kr").alias("k"), "share", (F.col("v_low") + (F.col("v_high") - F.col("v_low")) * F.col("part")).alias("q"))
