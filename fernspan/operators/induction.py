"""CN2 rule induction: an ordered list of rules by sequential covering, each found by a beam search.

A rule is a conjunction of column = value; it answers the most frequent class of the rows that it covers and that no rule before
it does.  A level of the search is one aggregate: every row not yet covered counts, by class, for each rule of the beam that
covers it and each value of a further column.  Quality (least entropy of the classes, then most rows) is an expression over these
counts, and only the best few rows come to the driver.  A rule is taken if its classes differ from those of all rows left, by the
likelihood ratio, at the given significance.  Covered rows are masked by a condition, never rewritten.

Defined results: a null matches no condition; rows without a class are not looked at; ties go to more rows, then fewer conditions, then
names and values in order; the class of a rule, to the first name; the last rule has no condition and answers for all rows left
(all rows, if none are left).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernspan.session import keep


@dataclass(frozen=True)
class Rule:
    conditions: tuple[tuple[str, str], ...]
    answer: str
    counts: tuple[int, ...]

    def covers(self) -> Column:
        parts = [F.coalesce(F.col(a) == v, F.lit(False)) for a, v in self.conditions]
        return reduce(lambda x, y: x & y, parts, F.lit(True))


def chi2_tail(x: float, df: int) -> float:
    """The chance that a chi-square of so many degrees of freedom is larger."""
    if df % 2:
        p, term, first = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 3
    else:
        p, term, first = math.exp(-x / 2), x / 2 * math.exp(-x / 2), 4
    for d in range(first, df + 1, 2):
        p += term
        term *= x / d
    return p


def critical(df: int, significance: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, df) > significance else (lo, mid)
    return hi


def _quality(n: list[Column]) -> tuple[Column, Column]:
    """Entropy of the classes, and all rows."""
    total = reduce(lambda a, b: a + b, n)
    entropy = reduce(lambda a, b: a + b, (F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in n))
    return F.round(entropy, 9), total


def induce(df: DataFrame, columns: list[str], label: str, beam: int = 5, longest: int = 3, least: int = 2, significance: float = 0.05, most_rules: int = 20) -> list[Rule]:
    """Rules in order; least: rows that a rule must cover."""
    rows = keep(df.select(*(F.col(c).cast("string").alias(c) for c in columns), F.col(label).cast("string").alias("__y")).filter("__y IS NOT NULL"), "cn2_rows")
    classes = sorted(r["__y"] for r in rows.select("__y").distinct().collect())
    if not classes:
        return []
    n_of = [F.count_if(F.col("__y") == c).alias(f"n{i}") for i, c in enumerate(classes)]
    n = [F.col(f"n{i}") for i in range(len(classes))]
    counts = lambda d: tuple(d.agg(*n_of).first())
    best_of = lambda own: classes[max(range(len(own)), key=lambda i: (own[i], -i))]
    limit = critical(max(len(classes) - 1, 1), significance)
    rules: list[Rule] = []
    left, before = rows, counts(rows)
    while len(rules) < most_rules and sum(c > 0 for c in before) > 1:
        best = None
        tried: list[tuple] = [()]
        for length in range(1, longest + 1):
            # one row for each rule of the beam that covers the row, and each further column
            fits = [Rule(t, "", ()).covers() for t in tried]
            which = F.filter(F.array(*(F.when(c, F.lit(i)) for i, c in enumerate(fits))), lambda i: i.isNotNull())
            used = F.array(*(F.array(*(F.lit(a) for a, _ in t)).cast("array<string>") for t in tried))
            cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))
            long = left.select("__y", F.explode(which).alias("rule"), cells.alias("cells")).select("__y", "rule", F.explode("cells").alias("cell")).select("__y", "rule", "cell.*")
            long = long.filter(F.col("value").isNotNull() & ~F.array_contains(F.get(used, F.col("rule")), F.col("column")))
            entropy, total = _quality(n)
            ratio = reduce(lambda a, b: a + b, (F.when(c > 0, c * F.log((c / F.col("all")) / F.lit(m / sum(before)))).otherwise(0.0) for c, m in zip(n, before, strict=True) if m))
            found = long.groupBy("rule", "column", "value").agg(*n_of).withColumn("entropy", entropy).withColumn("all", total).filter(F.col("all") >= least).withColumn("ratio", 2 * ratio)
            order = [F.col("entropy"), F.desc("all"), F.array_join(F.array_sort(F.concat(F.get(F.array(*(F.array(*(F.lit(f"{a}\x00{v}") for a, v in t)).cast("array<string>") for t in tried)), F.col("rule")), F.array(F.concat_ws("\x00", "column", "value")))), "\x01")]
            # a conjunction may be reached from each of its parts
            found = keep(found, "cn2_level")
            some = [*found.orderBy(*order).limit(beam * length).collect(), *found.filter(F.col("ratio") >= limit).orderBy(*order).limit(1).collect()]
            seen: dict[tuple, tuple] = {}
            for r in some:
                t = tuple(sorted([*tried[r["rule"]], (r["column"], r["value"])]))
                seen.setdefault(t, (r["entropy"], -r["all"], len(t), t, r["ratio"], tuple(r[f"n{i}"] for i in range(len(classes)))))
            fine = [x for x in seen.values() if x[4] >= limit]
            best = min([*([best] if best else []), *fine], key=lambda x: x[:4], default=None)
            tried = [x[3] for x in sorted(seen.values(), key=lambda x: x[:4])[:beam]]
            if not tried:
                break
        if best is None:
            break
        rule = Rule(best[3], best_of(best[5]), best[5])
        rules.append(rule)
        left = left.filter(~rule.covers())
        before = tuple(b - c for b, c in zip(before, rule.counts, strict=True))
    rest = before if any(before) else counts(rows)
    return [*rules, Rule((), best_of(rest), before)]


def applied(rules: list[Rule], df: DataFrame) -> DataFrame:
    """Adds rule (number, from 1) and answer: the first rule that covers the row."""
    fit = [r.covers() for r in rules]
    return df.withColumn("rule", F.coalesce(*(F.when(c, F.lit(i + 1)) for i, c in enumerate(fit)))).withColumn("answer", F.get(F.array(*(F.lit(r.answer) for r in rules)), F.col("rule") - 1))


def table_of(rules: list[Rule], df: DataFrame) -> DataFrame:
    """(rule, conditions, answer, covered, hits): a row a rule, counted on the rows that reach it."""
    out = [(i + 1, " and ".join(f"{a} = {v}" for a, v in r.conditions), r.answer, sum(r.counts), max(r.counts, default=0)) for i, r in enumerate(rules)]
    return df.sparkSession.createDataFrame(out, "rule int, conditions string, answer string, covered long, hits long")
