"""Evaluation of labelled predictions: matrices, costs, calibration, thresholds, curves, review and selection.

A prediction frame has ``y`` (true class), ``pred`` (served class) and ``proba`` (array of probabilities in the order of CLASSES).
Every result is an aggregate over it; grids (classes, thresholds, review costs) are small literal arrays that are exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Class order of the matrices, order of probabilities, costs (true class by predicted class), review costs.
LABELS = ("ham", "spam", "smishing")
CLASSES = ("ham", "smishing", "spam")
COST = {
    "ham": {"ham": 0.0, "spam": 1.0, "smishing": 2.0},
    "spam": {"ham": 0.0, "spam": 0.0, "smishing": 1.0},
    "smishing": {"ham": 20.0, "spam": 10.0, "smishing": 0.0},
}
TARGET = "smishing"
REVIEW_COST = 0.5
REVIEW_GRID = (0.14, 0.5, 1.0, 2.0)


def _cost_of(true: Column, pred: Column) -> Column:
    """The cost of an answer; pairs outside the configured classes cost nothing."""
    return reduce(lambda e, c: F.when((true == c[0]) & (pred == c[1]), c[2]).otherwise(e), ((t, p, COST[t][p]) for t in LABELS for p in LABELS), F.lit(0.0))


def probability(proba: Column, label: str) -> Column:
    return F.get(proba, F.lit(CLASSES.index(label)))


def expected_costs(proba: Column) -> list[Column]:
    """For each class in CLASSES the expected cost of answering it."""
    return [reduce(lambda a, b: a + b, (probability(proba, t) * COST[t][p] for t in CLASSES)) for p in CLASSES]


def argmin_class(values: list[Column]) -> Column:
    """The class of the smallest value, the first one on ties."""
    least = F.least(*values)
    return F.coalesce(*(F.when(v == least, F.lit(c)) for c, v in zip(CLASSES, values, strict=True)))


def argmax_class(proba: Column) -> Column:
    return argmin_class([-probability(proba, c) for c in CLASSES])


def min_cost_class(proba: Column) -> Column:
    return argmin_class(expected_costs(proba))


def answer_cost(proba: Column, pred: Column) -> Column:
    return reduce(lambda e, cv: F.when(pred == cv[0], cv[1]).otherwise(e), zip(CLASSES, expected_costs(proba), strict=True), F.lit(None).cast("double"))


def confusion(df: DataFrame) -> DataFrame:
    """Counts for every pair of classes that occur as truth or prediction, zeros included, in the configured order."""
    counts = df.groupBy("y", "pred").agg(F.count("*").alias("n"))
    seen = F.filter(F.array(*map(F.lit, LABELS)), lambda x: F.array_contains("__seen", x))
    present = counts.agg(F.array_union(F.collect_set("y"), F.collect_set("pred")).alias("__seen")).select(seen.alias("labels"))
    grid = present.select(F.posexplode("labels").alias("row", "y"), "labels").select("row", "y", F.posexplode("labels").alias("col", "pred"))
    return grid.join(counts, ["y", "pred"], "left").select("row", "col", "y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per class (and key): support, predicted, hits, precision, recall, f1; divisions by zero give 0."""
    keys = keys or []
    each = df.select(*keys, F.explode(F.array_distinct(F.array("y", "pred"))).alias("label"), "y", "pred")
    s = each.groupBy(*keys, "label").agg(F.count_if(F.col("y") == F.col("label")).alias("support"), F.count_if(F.col("pred") == F.col("label")).alias("predicted"), F.count_if((F.col("y") == F.col("label")) & (F.col("pred") == F.col("label"))).alias("hits"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    s = s.withColumn("precision", share("hits", "predicted")).withColumn("recall", share("hits", "support"))
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0)))


def summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, accuracy, macro F1 over the classes present, and the target's precision, recall and F1."""
    keys = keys or []
    m = class_metrics(df, keys)
    of = lambda c: F.coalesce(F.max(F.when(F.col("label") == TARGET, F.col(c))), F.lit(0.0))
    return m.groupBy(*keys).agg(F.sum("support").alias("n"), (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), of("precision").alias("target_precision"), of("recall").alias("target_recall"), of("f1").alias("target_f1"))


def mean_cost(df: DataFrame) -> Column:
    return F.sum(_cost_of(F.col("y"), F.col("pred"))) / F.greatest(F.count("*"), F.lit(1))


def brier(proba: Column, y: Column) -> Column:
    terms = [F.pow(probability(proba, c) - F.when(y == c, 1.0).otherwise(0.0), F.lit(2.0)) for c in CLASSES]
    return F.avg(reduce(lambda a, b: a + b, terms))


def calibration(df: DataFrame, label: str = TARGET, bins: int = 5) -> DataFrame:
    """Reliability of one class's probability in equal bins, open on the right, the last one closed; empty bins are left out."""
    p = probability(F.col("proba"), label)
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    b = reduce(lambda a, e: a + (p >= e).cast("int"), edges, F.lit(0))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg((F.col("y") == label).cast("double")).alias("observed"))


def threshold_sweep(df: DataFrame, thresholds: list[float], label: str = TARGET) -> DataFrame:
    """Macro F1 of 'label or not' at every threshold: the scores are counted by the thresholds they pass, in one aggregate."""
    p, hit = probability(F.col("proba"), label), F.col("y") == label
    passed = reduce(lambda a, t: a + (p >= t).cast("int"), thresholds, F.lit(0))
    by = df.groupBy(passed.alias("k")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # as many rows as thresholds
    total = Window.partitionBy()
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)], "k int, threshold double")
    filled = grid.unionByName(df.sparkSession.createDataFrame([(0, -1.0)], "k int, threshold double")).join(by, "k", "left").fillna(0, ["n", "hits"])
    c = filled.withColumn("tp", F.sum("hits").over(w)).withColumn("called", F.sum("n").over(w)).withColumn("pos", F.sum("hits").over(total)).withColumn("all", F.sum("n").over(total)).filter("k > 0")
    f1 = lambda tp, a, b: F.coalesce(F.try_divide(2 * tp, a + b), F.lit(0.0))
    yes = f1(F.col("tp"), F.col("called"), F.col("pos"))
    tn = F.col("all") - F.col("pos") - F.col("called") + F.col("tp")
    no = f1(tn, F.col("all") - F.col("called"), F.col("all") - F.col("pos"))
    return c.select("threshold", ((yes + no) / 2).alias("macro_f1"), "tp", "called", "pos")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold among those of the highest macro F1."""
    return sweep.agg(F.min(F.struct((-F.round("macro_f1", 9)).alias("s"), "threshold", "macro_f1")).alias("b")).select("b.threshold", "b.macro_f1")


def curve(df: DataFrame, score: Column, hit: Column) -> DataFrame:
    """Cumulative counts by distinct score, highest first: threshold, called, tp, precision, recall.

    Scores are counted first; running totals then go over distinct scores in ranges: totals of ranges on one small window,
    the rest within each range, so no window holds all scores.
    """
    by = df.groupBy(score.alias("score")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    r = by.withColumn("range", F.floor(F.col("score") * 64))
    whole = r.groupBy("range").agg(F.sum("n").alias("rn"), F.sum("hits").alias("rh"))
    before = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    whole = whole.select("range", F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("rh").over(before), F.lit(0)).alias("bh"), F.sum("rh").over(total).alias("pos"), F.sum("rn").over(total).alias("all"))
    w = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    c = r.join(F.broadcast(whole), "range").withColumn("called", F.col("bn") + F.sum("n").over(w)).withColumn("tp", F.col("bh") + F.sum("hits").over(w))
    return c.select("score", "n", "hits", "called", "tp", "pos", "all", (F.col("tp") / F.col("called")).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("pos")), F.lit(0.0)).alias("recall"))


def auc(df: DataFrame, score: Column, hit: Column) -> DataFrame:
    """Area under the ROC curve with ties halved (the rank-sum statistic)."""
    c = curve(df, score, hit)
    # a hit beats every miss below it and half of those at its score
    wins = F.sum(F.col("hits") * ((F.col("all") - F.col("pos")) - (F.col("called") - F.col("tp")) + (F.col("n") - F.col("hits")) / 2))
    return c.agg((wins / (F.max("pos") * (F.max("all") - F.max("pos")))).alias("auc"), F.max("pos").alias("positives"), F.max("all").alias("n"))


def review_table(df: DataFrame, grid: tuple[float, ...] = REVIEW_GRID) -> DataFrame:
    """Review load for every review cost: rows go to a person where the expected cost of the answer exceeds it."""
    own = answer_cost(F.col("proba"), F.col("pred"))
    d = df.withColumn("__own", own).select("*", F.explode(F.array(*map(F.lit, grid))).alias("review_cost"))
    wrong = F.col("pred") != F.col("y")
    missed = (F.col("y") == TARGET) & (F.col("pred") != TARGET)
    alarm = (F.col("y") == "ham") & (F.col("pred") != "ham")
    r = F.col("__own") > F.col("review_cost")
    return d.groupBy("review_cost").agg(
        F.count("*").alias("messages"), F.count_if(r).alias("reviewed"), F.count_if(wrong).alias("errors"), F.count_if(wrong & r).alias("errors_reviewed"), F.count_if(missed).alias("missed"), F.count_if(missed & r).alias("missed_reviewed"),
        F.count_if(alarm).alias("false_alarms"), F.count_if(alarm & r).alias("false_alarms_reviewed"), *(F.count_if(r & (F.col("pred") == c)).alias(f"reviewed_{c}") for c in CLASSES),
    )


def select_model(board: DataFrame, cap: float) -> DataFrame:
    """Of the models under the false-alarm cap (of all, if none is) the one with the best macro F1, then target recall, then name."""
    ok = (F.col("false_alarm") <= cap).cast("int")
    order = F.struct((-ok).alias("a"), (-F.col("macro_f1")).alias("b"), (-F.col("target_recall")).alias("c"), F.col("model"))
    return board.agg(F.min(F.struct(order.alias("o"), *(F.col(c) for c in board.columns))).alias("b")).select(*(F.col(f"b.{c}").alias(c) for c in board.columns))


def worst_misses(df: DataFrame, top: int = 15) -> DataFrame:
    """Missed target rows, the least probable first."""
    p = probability(F.col("proba"), TARGET)
    return df.filter((F.col("y") == TARGET) & (F.col("pred") != TARGET)).withColumn("p_target", p).orderBy("p_target", "doc_id").limit(top)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agree"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("share"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * rows of the class)."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return c.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def _drawn(group: str, draw: str, seed: int) -> Column:
    """How often a group is in a draw: Poisson(1) from a hash of both, by its cumulative probabilities."""
    u = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), group, draw)), 1, 8), 16, 10).cast("double") / 4294967296.0
    return reduce(lambda a, t: a + (u >= t).cast("int"), POISSON_STEPS, F.lit(0))


def _poisson_steps() -> list[float]:
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 8):
        total += p
        steps.append(total)
        p /= k
    return steps


POISSON_STEPS = _poisson_steps()


def bootstrap_metrics(df: DataFrame, groups: Column, draws: int, seed: int, label: str = TARGET) -> DataFrame:
    """(metric, lo, hi, mean): percentile intervals of accuracy, macro F1 and the target's precision, recall and F1, whole groups resampled.

    Groups are reduced to their counts of (class, answer) first; a draw is one sum over these, and its metrics follow from the sums.
    """
    pairs = [(t, p) for t in LABELS for p in LABELS]
    by = df.groupBy(groups.alias("g")).agg(*(F.count_if((F.col("y") == t) & (F.col("pred") == p)).alias(f"{t}_{p}") for t, p in pairs))
    each = by.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("times", _drawn("g", "draw", seed))
    d = each.groupBy("draw").agg(*(F.sum(F.col("times") * F.col(f"{t}_{p}")).alias(f"{t}_{p}") for t, p in pairs))
    total = lambda cells: reduce(lambda a, b: a + b, (F.col(f"{t}_{p}") for t, p in cells))
    support, answered = {c: total((c, p) for p in LABELS) for c in LABELS}, {c: total((t, c) for t in LABELS) for c in LABELS}
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = {c: F.try_divide(2 * F.col(f"{c}_{c}"), support[c] + answered[c]) for c in LABELS}
    met = {c: F.when(support[c] + answered[c] > 0, 1).otherwise(0) for c in LABELS}
    values = {
        "accuracy": share(total((c, c) for c in LABELS), total(pairs)),
        "macro_f1": share(reduce(lambda a, b: a + b, (F.coalesce(f1[c], F.lit(0.0)) for c in LABELS)), reduce(lambda a, b: a + b, met.values())),
        "precision": share(F.col(f"{label}_{label}"), answered[label]),
        "recall": share(F.col(f"{label}_{label}"), support[label]),
        "f1": F.coalesce(f1[label], F.lit(0.0)),
    }
    long = d.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()))).alias("x")).select("x.*")
    # a value a draw: as many as were asked for
    return long.groupBy("metric").agg(F.percentile("value", F.lit(0.025)).alias("lo"), F.percentile("value", F.lit(0.975)).alias("hi"), F.avg("value").alias("mean"))


def bootstrap(df: DataFrame, groups: Column, draws: int, seed: int, label: str = TARGET) -> DataFrame:
    """Percentile interval of the target's recall: whole groups are resampled, by Poisson weights from a hash of (group, draw).

    Groups are reduced to (support, hits) first, then each draw is one grouped sum over them.
    """
    by = df.groupBy(groups.alias("g")).agg(F.count_if(F.col("y") == label).alias("support"), F.count_if((F.col("y") == label) & (F.col("pred") == label)).alias("hits")).filter("support > 0")
    each = by.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    weight = _drawn("g", "draw", seed)
    s = each.groupBy("draw").agg(F.sum(weight * F.col("hits")).alias("h"), F.sum(weight * F.col("support")).alias("s")).select(F.coalesce(F.try_divide("h", "s"), F.lit(0.0)).alias("recall"))
    return s.agg(F.percentile("recall", F.lit(0.025)).alias("lo"), F.percentile("recall", F.lit(0.975)).alias("hi"), F.avg("recall").alias("mean"), F.count("*").alias("draws"))
