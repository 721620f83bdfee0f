"""Set statistics over tables: profiles, contingency, pivots, distributions, regression, encodings, information gain, top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernspan.operators.selection import quantiles


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """Counts and shares by key; the total is a window over the few counted rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def describe_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """count, mean, std (n-1), min, quartiles (interpolated, exact), max for each key; no group is in one task."""
    one = df.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    q = quantiles(df, F.col(key), F.col(value), [*shares.values()])
    q = q.groupBy("k").agg(*(F.max(F.when(F.col("share") == s, F.round("q", 6))).alias(n) for n, s in shares.items()))
    return one.join(q, F.col(key).eqNullSafe(F.col("k")), "left").select(key, "n", "mean", "std", "min", *shares, "max")


def median_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): exact, interpolated; null where a key has no value."""
    q = quantiles(df, F.col(key), F.col(value), [0.5]).select("k", F.col("q").alias("median"))
    return df.select(key).distinct().join(q, F.col(key).eqNullSafe(F.col("k")), "left").select(key, "median")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table with margins; level 0 cells, 1 totals by a, 2 totals by b, 3 the grand total."""
    return df.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def pivot_counts(df: DataFrame, key: str, over: str, values: list) -> DataFrame:
    """Counts by key with one column for each of the given values, and the row total and the shares."""
    wide = df.groupBy(key).pivot(over, values).count().fillna(0)
    total = reduce(lambda x, y: x + y, (F.col(str(v)) for v in values))
    return wide.withColumn("total", total)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, share) of every column, in one pass."""
    n = len(df.columns)
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)))
    args = ", ".join(f"'{c}', c{i}" for i, c in enumerate(df.columns))
    return one.select("rows", F.expr(f"stack({n}, {args}) AS (column, nulls)")).select("column", "nulls", F.round(F.col("nulls") / F.greatest("rows", F.lit(1)), 6).alias("share"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts by bin; bins are closed on the left, the last one on both sides; values outside belong to no bin."""
    v = F.col(value)
    b = F.when(v == hi, bins).otherwise(F.floor((v - lo) / ((hi - lo) / bins)) + 1)
    inside = df.filter((v >= lo) & (v <= hi))
    return inside.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    args = ", ".join(f"'{a}', '{b}', p{i}" for i, (a, b) in enumerate(pairs))
    return one.select(F.expr(f"stack({len(pairs)}, {args}) AS (a, b, r)")).withColumn("r", F.round("r", 6))


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, intercept, rows and root mean squared error of a straight line."""
    fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    rmse = F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.col("n"))
    return fit.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n", F.round(rmse, 4).alias("rmse"))


def linear_score(x: Column, intercept: float, slope: float) -> Column:
    return F.lit(intercept) + F.lit(slope) * x


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; the statistics are one row, broadcast."""
    stats = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.join(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(f"z_{c}", F.when(F.col(f"__s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")))
    return out.drop(*[f"__{n}_{c}" for c in columns for n in "ms"])


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    for v in values:
        df = df.withColumn(f"{column}_{v}", F.coalesce((F.col(column) == v).cast("int"), F.lit(0)))
    return df


def _entropy(df: DataFrame, keys: list[str], label: str, weight: str | None = None) -> DataFrame:
    n = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    t = n.groupBy(*keys).agg(F.sum("n").alias("t"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))
    return t


def info_gain(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """Entropy of the label less its expected entropy given each attribute (nulls are a value)."""
    long = df.select(label, F.expr(f"stack({len(attributes)}, {', '.join(f'{chr(39)}{a}{chr(39)}, cast({a} AS string)' for a in attributes)}) AS (attribute, value)"))
    inner = _entropy(long, ["attribute", "value"], label).groupBy("attribute").agg((F.sum(F.col("t") * F.col("h")) / F.sum("t")).alias("rest"))
    whole = _entropy(df, [], label).select(F.col("h").alias("whole"))
    return inner.join(F.broadcast(whole)).select("attribute", F.round(F.col("whole") - F.col("rest"), 6).alias("gain"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def row_of_maximum(df: DataFrame, keys: list[str], score: Column, first: list[str]) -> DataFrame:
    """Of each group the row with the highest score; ties go to the smallest key columns."""
    names = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct((-score).alias("__s"), *(F.col(c) for c in first), *(F.col(c).alias(f"__{c}") for c in names))).alias("__b"))
    return best.select(*keys, *(F.col("__b")[f"__{c}"].alias(c) for c in names))


def sampled(df: DataFrame, key: Column, n: int) -> DataFrame:
    """A repeatable random sample: the n rows whose key has the smallest md5."""
    return df.orderBy(F.md5(key.cast("string")), key).limit(n)


def complement(df: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    return df.join(held.select(*on).distinct(), on, "left_anti")


def disjoint(a: DataFrame, b: DataFrame, on: list[str]) -> bool:
    return a.select(*on).intersect(b.select(*on)).isEmpty()
