"""Queries: evaluation of predictions derived from documents and labels by arithmetic, so that oracles are exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernspan.operators import metrics as M
from fernspan.operators import tabular
from fernspan.session import table


def predictions(spark, sf):
    """doc_id, source, lang, y, proba, pred (argmax): numbers a, b, c of the row, the true class's one tripled, over their sum."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    y = F.when(F.col("toxic") == 1, "smishing").when(F.col("quality") == 0, "spam").otherwise("ham")
    part = lambda k, m, c: (F.pmod(F.col("doc_id") * k + F.col("n_chars") * m, F.lit(997)) + 1) * F.when(F.col("y") == c, 3).otherwise(1)
    d = d.withColumn("y", y).select("doc_id", "source", "lang", "y", part(7919, 31, "ham").alias("a"), part(104729, 17, "smishing").alias("b"), part(1299709, 5, "spam").alias("c"))
    total = F.col("a") + F.col("b") + F.col("c")
    d = d.withColumn("proba", F.array(*(F.col(x) / total for x in "abc")))
    return d.select("doc_id", "source", "lang", "y", "proba", M.argmax_class(F.col("proba")).alias("pred"))


R = lambda c, n=6: F.round(c, n)


def confusion_matrix(spark, sf):
    return M.confusion(predictions(spark, sf)).select("y", "pred", "n")


def class_metrics(spark, sf):
    return M.class_metrics(predictions(spark, sf)).select("label", "support", "predicted", "hits", R("precision").alias("precision"), R("recall").alias("recall"), R("f1").alias("f1"))


def model_summary(spark, sf):
    s = M.summary(predictions(spark, sf), ["lang"])
    return s.select("lang", "n", *(R(c).alias(c) for c in s.columns[2:]))


def expected_cost(spark, sf):
    return predictions(spark, sf).groupBy("lang").agg(R(M.mean_cost(None)).alias("cost"), F.count("*").alias("n"))


def min_cost_decision(spark, sf):
    p = predictions(spark, sf)
    return p.select("doc_id", M.min_cost_class(F.col("proba")).alias("min_cost"), "pred", R(M.answer_cost(F.col("proba"), F.col("pred"))).alias("own_cost"), R(F.array_max("proba")).alias("confidence"))


def needs_review(spark, sf):
    p = predictions(spark, sf).withColumn("r", M.answer_cost(F.col("proba"), F.col("pred")) > M.REVIEW_COST)
    return p.groupBy("pred").agg(F.count("*").alias("n"), F.count_if("r").alias("reviewed"))


def review_grid(spark, sf):
    return M.review_table(predictions(spark, sf))


def brier_score(spark, sf):
    return predictions(spark, sf).groupBy("lang").agg(R(M.brier(F.col("proba"), F.col("y"))).alias("brier"))


def calibration_bins(spark, sf):
    c = M.calibration(predictions(spark, sf))
    return c.select("bin", "n", R("mean_p").alias("mean_p"), R("observed").alias("observed"))


THRESHOLDS = [round(0.2 + 0.01 * i, 2) for i in range(61)]


def threshold_sweep(spark, sf):
    s = M.threshold_sweep(predictions(spark, sf), THRESHOLDS)
    return s.select("threshold", R("macro_f1").alias("macro_f1"), "tp", "called")


def best_threshold(spark, sf):
    b = M.best_threshold(M.threshold_sweep(predictions(spark, sf), THRESHOLDS))
    return b.select("threshold", R("macro_f1").alias("macro_f1"))


def roc_auc(spark, sf):
    p = predictions(spark, sf)
    return M.auc(p, M.probability(F.col("proba"), M.TARGET), F.col("y") == M.TARGET).select(R("auc").alias("auc"), "positives", "n")


def pr_curve(spark, sf):
    p = predictions(spark, sf)
    c = M.curve(p, M.probability(F.col("proba"), M.TARGET), F.col("y") == M.TARGET)
    return c.select(R("score", 9).alias("score"), "called", "tp", R("precision").alias("precision"), R("recall").alias("recall"))


def worst_misses(spark, sf):
    return M.worst_misses(predictions(spark, sf)).select("doc_id", "pred", R("p_target").alias("p_target"))


def _board(spark, sf):
    """Three decision rules as models: argmax, min-cost, target from 0.4."""
    p = predictions(spark, sf)
    rules = {"argmax": F.col("pred"), "min_cost": M.min_cost_class(F.col("proba")), "target_04": F.when(M.probability(F.col("proba"), M.TARGET) >= 0.4, M.TARGET).otherwise("ham")}
    out = None
    for name, rule in rules.items():
        m = p.select(F.lit(name).alias("model"), "y", rule.alias("pred"))
        out = m if out is None else out.unionByName(m)
    return out


def operating_points(spark, sf):
    d = _board(spark, sf)
    s = M.summary(d, ["model"])
    extra = d.groupBy("model").agg(F.avg(F.when(F.col("y") == "ham", (F.col("pred") != "ham").cast("double"))).alias("false_alarm"), M.mean_cost(None).alias("cost"))
    return s.join(extra, "model").select("model", "n", *(R(c).alias(c) for c in ("accuracy", "macro_f1", "target_precision", "target_recall", "false_alarm", "cost")))


def leaderboard_select(spark, sf):
    return M.select_model(operating_points(spark, sf), 0.3).select("model", "macro_f1", "target_recall", "false_alarm")


def agreement_table(spark, sf):
    d = predictions(spark, sf).withColumn("other", M.min_cost_class(F.col("proba")))
    return d.groupBy("pred", "other").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("other")).alias("agree"))


def class_weights(spark, sf):
    return M.class_weights(predictions(spark, sf), "y").select("y", "n", R("weight").alias("weight"))


def score_map(spark, sf):
    """Label, confidence and per-class score map (in ten-thousandths) of every prediction."""
    d = predictions(spark, sf)
    m = F.map_from_arrays(F.array(*map(F.lit, M.CLASSES)), "proba")
    return d.select("doc_id", F.col("pred").alias("label"), R(F.element_at(m, F.col("pred"))).alias("confidence"), F.concat_ws(";", *(F.concat(F.lit(f"{c}="), F.floor(F.element_at(m, F.lit(c)) * 10000).cast("string")) for c in M.CLASSES)).alias("scores"))


def evaluation_report(spark, sf):
    p = predictions(spark, sf)
    s = M.summary(p)
    c = p.agg(F.count_distinct(F.when(F.col("y") == M.TARGET, F.col("source"))).alias("target_groups"))
    return s.join(F.broadcast(c)).select("n", R("accuracy").alias("accuracy"), R("macro_f1").alias("macro_f1"), R("target_recall").alias("target_recall"), "target_groups")


def bootstrap_ci(spark, sf):
    b = M.bootstrap(predictions(spark, sf), F.col("source"), 2000, 42)
    return b.select(R("lo").alias("lo"), R("hi").alias("hi"), R("mean").alias("mean"), "draws")


def bootstrap_metrics(spark, sf):
    b = M.bootstrap_metrics(predictions(spark, sf), F.col("source"), 2000, 42)
    return b.select("metric", R("lo").alias("lo"), R("hi").alias("hi"), R("mean").alias("mean"))


def most_certain(spark, sf):
    """The twenty documents whose target probability is farthest from a half."""
    p = predictions(spark, sf).select("doc_id", M.probability(F.col("proba"), M.TARGET).alias("p"))
    return p.orderBy(F.desc(F.abs(F.col("p") - 0.5)), "doc_id").limit(20).select("doc_id", R("p").alias("p_target"))


def repeated_summary(spark, sf):
    """Gain of min-cost over argmax in target recall, over six groups of documents: mean, times better, least and most."""
    p = predictions(spark, sf)
    by = p.withColumn("seed", F.pmod(F.col("doc_id"), F.lit(6))).withColumn("mc", M.min_cost_class(F.col("proba"))).filter(F.col("y") == M.TARGET)
    r = by.groupBy("seed").agg(F.avg((F.col("mc") == M.TARGET).cast("double")).alias("a"), F.avg((F.col("pred") == M.TARGET).cast("double")).alias("b"))
    g = r.withColumn("gain", F.col("a") - F.col("b"))
    return g.agg(R(F.avg("gain")).alias("mean_gain"), F.count_if(F.col("gain") > 0).alias("better"), R(F.min("gain")).alias("least"), R(F.max("gain")).alias("most"))


def before_after(spark, sf):
    """Seven metrics of two thresholds, one row each."""
    d = predictions(spark, sf)
    p = M.probability(F.col("proba"), M.TARGET)
    out = None
    for name, t in (("before", 0.5), ("after", 0.35)):
        hit, call = F.col("y") == M.TARGET, p >= t
        tp, fp, fn, tn = (F.count_if(x) for x in (hit & call, ~hit & call, hit & ~call, ~hit & ~call))
        row = d.agg(F.lit(name).alias("run"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), R((tp + tn) / F.count("*")).alias("accuracy"), (fp + fn).alias("errors"))
        out = row if out is None else out.unionByName(row)
    return out


def decided_classes(spark, sf):
    """Threshold decision with the probability rounded to four places."""
    d = predictions(spark, sf)
    p = M.probability(F.col("proba"), M.TARGET)
    return d.select("doc_id", F.when(p >= 0.54, "TARGET").otherwise("OTHER").alias("decision"), F.round(p, 4).alias("p"))


QUERIES = {
    f.__name__: f
    for f in (
        confusion_matrix, class_metrics, model_summary, expected_cost, min_cost_decision, needs_review, review_grid, brier_score, calibration_bins, threshold_sweep, best_threshold, roc_auc, pr_curve, worst_misses, operating_points, leaderboard_select,
        agreement_table, class_weights, score_map, evaluation_report, bootstrap_ci, bootstrap_metrics, most_certain, repeated_summary, before_after, decided_classes,
    )
}

_Y = "CASE WHEN toxic = 1 THEN 'smishing' WHEN quality = 0 THEN 'spam' ELSE 'ham' END"


def _part(k: int, m: int, c: str) -> str:
    return f"((doc_id * {k} + n_chars * {m}) % 997 + 1) * CASE WHEN y = '{c}' THEN 3 ELSE 1 END"


_P = f"""
WITH l AS (SELECT doc_id, source, lang, n_chars, {_Y} AS y FROM documents JOIN labels USING (doc_id)),
n AS (SELECT *, {_part(7919, 31, 'ham')} AS a, {_part(104729, 17, 'smishing')} AS b, {_part(1299709, 5, 'spam')} AS c FROM l),
q AS (SELECT doc_id, source, lang, y, a / (a + b + c) AS ph, b / (a + b + c) AS pt, c / (a + b + c) AS ps FROM n),
e AS (SELECT *, pt * 20 AS ch, ph * 2 + ps * 1 AS ct, ph * 1 + pt * 10 AS cs FROM q),
p AS (SELECT *, CASE WHEN ph >= pt AND ph >= ps THEN 'ham' WHEN pt >= ps THEN 'smishing' ELSE 'spam' END AS pred, CASE WHEN ch <= ct AND ch <= cs THEN 'ham' WHEN ct <= cs THEN 'smishing' ELSE 'spam' END AS mc FROM e),
o AS (SELECT *, CASE pred WHEN 'ham' THEN ch WHEN 'smishing' THEN ct ELSE cs END AS own,
      CASE WHEN y = 'ham' AND pred = 'spam' THEN 1.0 WHEN y = 'ham' AND pred = 'smishing' THEN 2.0 WHEN y = 'spam' AND pred = 'smishing' THEN 1.0 WHEN y = 'smishing' AND pred = 'ham' THEN 20.0 WHEN y = 'smishing' AND pred = 'spam' THEN 10.0 ELSE 0.0 END::DOUBLE AS cost FROM p)
"""
_LAB = "(VALUES ('ham'), ('spam'), ('smishing')) v(label)"


def _metrics(frm: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""SELECT {k}label, count(*) FILTER (y = label) AS support, count(*) FILTER (pred = label) AS predicted, count(*) FILTER (y = label AND pred = label) AS hits FROM {frm}, {_LAB} WHERE y = label OR pred = label GROUP BY {k}label"""


_F1 = "coalesce(2 * hits / nullif(support + predicted, 0), 0)"
_PREC, _REC = "coalesce(hits / nullif(predicted, 0), 0)", "coalesce(hits / nullif(support, 0), 0)"
_SUM = f"cast(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support), 6) AS accuracy, round(avg({_F1}), 6) AS macro_f1, round(coalesce(max({_PREC}) FILTER (label = 'smishing'), 0), 6) AS target_precision, round(coalesce(max({_REC}) FILTER (label = 'smishing'), 0), 6) AS target_recall"
_SWEEP = _P + """, t AS (SELECT unnest([""" + ", ".join(map(str, THRESHOLDS)) + """])::DOUBLE AS threshold),
s AS (SELECT threshold, count(*) FILTER (pt >= threshold AND y = 'smishing') AS tp, count(*) FILTER (pt >= threshold) AS called, count(*) FILTER (y = 'smishing') AS pos, count(*) AS n FROM o, t GROUP BY threshold),
f AS (SELECT *, (coalesce(2 * tp / nullif(called + pos, 0), 0) + coalesce(2 * (n - pos - called + tp) / nullif(n - called + n - pos, 0), 0)) / 2 AS f FROM s)
"""
_BOARD = _P + ", m AS (SELECT 'argmax' AS model, y, pred FROM p UNION ALL SELECT 'min_cost', y, mc FROM p UNION ALL SELECT 'target_04', y, CASE WHEN pt >= 0.4::DOUBLE THEN 'smishing' ELSE 'ham' END FROM p), "
_BOARD += f"""s AS (SELECT model, {_SUM} FROM ({_metrics('m', 'model')}) GROUP BY model),
x AS (SELECT model, round(avg(CASE WHEN y = 'ham' THEN (pred <> 'ham')::INT END), 6) AS false_alarm,
  round(sum(CASE WHEN y = 'ham' AND pred = 'spam' THEN 1.0 WHEN y = 'ham' AND pred = 'smishing' THEN 2.0 WHEN y = 'spam' AND pred = 'smishing' THEN 1.0 WHEN y = 'smishing' AND pred = 'ham' THEN 20.0 WHEN y = 'smishing' AND pred = 'spam' THEN 10.0 ELSE 0.0 END::DOUBLE) / count(*), 6) AS cost FROM m GROUP BY model),
b AS (SELECT s.*, false_alarm, cost FROM s JOIN x USING (model))"""
_POIS, _t, _p = [], 0.0, 0.36787944117144233
for _k in range(1, 8):
    _t += _p
    _POIS.append(f"(u >= {_t!r}::DOUBLE)::INT")
    _p /= _k

ORACLES = {
    "confusion_matrix": _P + f", a AS (SELECT label FROM {_LAB} WHERE label IN (SELECT y FROM p) OR label IN (SELECT pred FROM p)) SELECT a.label AS y, b.label AS pred, (SELECT count(*) FROM p WHERE p.y = a.label AND p.pred = b.label) AS n FROM a, a b",
    "class_metrics": _P + f"SELECT label, support, predicted, hits, round({_PREC}, 6) AS precision, round({_REC}, 6) AS recall, round({_F1}, 6) AS f1 FROM ({_metrics('p')})",
    "model_summary": _P + f"SELECT lang, {_SUM}, round(coalesce(max({_F1}) FILTER (label = 'smishing'), 0), 6) AS target_f1 FROM ({_metrics('p', 'lang')}) GROUP BY lang",
    "expected_cost": _P + "SELECT lang, round(sum(cost) / count(*), 6) AS cost, count(*) AS n FROM o GROUP BY lang",
    "min_cost_decision": _P + "SELECT doc_id, mc AS min_cost, pred, round(own, 6) AS own_cost, round(greatest(ph, pt, ps), 6) AS confidence FROM o",
    "needs_review": _P + "SELECT pred, count(*) AS n, count(*) FILTER (own > 0.5::DOUBLE) AS reviewed FROM o GROUP BY pred",
    "review_grid": _P + ", g AS (SELECT unnest([0.14, 0.5, 1.0, 2.0])::DOUBLE AS review_cost) SELECT review_cost, count(*) AS messages, count(*) FILTER (own > review_cost) AS reviewed, count(*) FILTER (pred <> y) AS errors, count(*) FILTER (pred <> y AND own > review_cost) AS errors_reviewed, count(*) FILTER (y = 'smishing' AND pred <> y) AS missed, count(*) FILTER (y = 'smishing' AND pred <> y AND own > review_cost) AS missed_reviewed, count(*) FILTER (y = 'ham' AND pred <> y) AS false_alarms, count(*) FILTER (y = 'ham' AND pred <> y AND own > review_cost) AS false_alarms_reviewed, "
    + ", ".join(f"count(*) FILTER (pred = '{c}' AND own > review_cost) AS reviewed_{c}" for c in M.CLASSES) + " FROM o, g GROUP BY review_cost",
    "brier_score": _P + "SELECT lang, round(avg((ph - (y = 'ham')::INT) ** 2 + (pt - (y = 'smishing')::INT) ** 2 + (ps - (y = 'spam')::INT) ** 2), 6) AS brier FROM o GROUP BY lang",
    "calibration_bins": _P + "SELECT (pt >= 0.2::DOUBLE)::INT + (pt >= 0.4::DOUBLE)::INT + (pt >= 0.6000000000000001::DOUBLE)::INT + (pt >= 0.8::DOUBLE)::INT AS bin, count(*) AS n, round(avg(pt), 6) AS mean_p, round(avg((y = 'smishing')::INT), 6) AS observed FROM o GROUP BY 1",
    "threshold_sweep": _SWEEP + "SELECT threshold, round(f, 6) AS macro_f1, tp, called FROM f",
    "best_threshold": _SWEEP + "SELECT threshold, round(f, 6) AS macro_f1 FROM f ORDER BY round(f, 9) DESC, threshold LIMIT 1",
    "roc_auc": _P + ", r AS (SELECT y, rank() OVER (ORDER BY pt) + (count(*) OVER (PARTITION BY pt) - 1) / 2 AS r FROM o), z AS (SELECT count(*) FILTER (y = 'smishing') AS pos, count(*) AS n, sum(CASE WHEN y = 'smishing' THEN r END) AS s FROM r) SELECT round((s - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS auc, pos AS positives, n FROM z",
    "pr_curve": _P + ", g AS (SELECT pt, count(*) AS n, count(*) FILTER (y = 'smishing') AS h FROM o GROUP BY pt), w AS (SELECT pt, sum(n) OVER (ORDER BY pt DESC) AS called, sum(h) OVER (ORDER BY pt DESC) AS tp, sum(h) OVER () AS pos FROM g) SELECT round(pt, 9) AS score, cast(called AS BIGINT) AS called, cast(tp AS BIGINT) AS tp, round(tp / called, 6) AS precision, round(coalesce(tp / nullif(pos, 0), 0), 6) AS recall FROM w",
    "worst_misses": _P + "SELECT doc_id, pred, round(pt, 6) AS p_target FROM o WHERE y = 'smishing' AND pred <> 'smishing' ORDER BY pt, doc_id LIMIT 15",
    "operating_points": _BOARD + " SELECT model, n, accuracy, macro_f1, target_precision, target_recall, false_alarm, cost FROM b",
    "leaderboard_select": _BOARD + " SELECT model, macro_f1, target_recall, false_alarm FROM b ORDER BY (false_alarm <= 0.3)::INT DESC, macro_f1 DESC, target_recall DESC, model LIMIT 1",
    "agreement_table": _P + "SELECT pred, mc AS other, count(*) AS n, count(*) FILTER (pred = mc) AS agree FROM o GROUP BY pred, mc",
    "class_weights": _P + "SELECT y, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM o GROUP BY y",
    "score_map": _P + "SELECT doc_id, pred AS label, round(CASE pred WHEN 'ham' THEN ph WHEN 'smishing' THEN pt ELSE ps END, 6) AS confidence, 'ham=' || floor(ph * 10000)::BIGINT || ';smishing=' || floor(pt * 10000)::BIGINT || ';spam=' || floor(ps * 10000)::BIGINT AS scores FROM o",
    "evaluation_report": _P + f"SELECT n, accuracy, macro_f1, target_recall, (SELECT count(DISTINCT source) FROM p WHERE y = 'smishing') AS target_groups FROM (SELECT {_SUM} FROM ({_metrics('p')}))",
    "most_certain": _P + "SELECT doc_id, round(pt, 6) AS p_target FROM p ORDER BY abs(pt - 0.5) DESC, doc_id LIMIT 20",
    "bootstrap_metrics": _P
    + ", g AS (SELECT source, y, pred, count(*) AS n FROM p GROUP BY ALL), u AS (SELECT source, draw, ('0x' || substr(md5('42/' || source || '/' || draw), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT source FROM g), generate_series(1, 2000) x(draw)), "
    + f"t AS (SELECT source, draw, {' + '.join(f'(u >= {s!r}::DOUBLE)::INT' for s in M.POISSON_STEPS)} AS times FROM u), "
    + "c AS (SELECT draw, y, pred, sum(n * times) AS n FROM g JOIN t USING (source) GROUP BY ALL), k AS (SELECT draw, cl, coalesce(sum(n) FILTER (y = cl), 0) AS s, coalesce(sum(n) FILTER (pred = cl), 0) AS a, coalesce(sum(n) FILTER (y = cl AND pred = cl), 0) AS h FROM c, unnest(['ham', 'spam', 'smishing']) x(cl) GROUP BY ALL), "
    + "m AS (SELECT draw, coalesce(sum(h) / nullif(sum(s), 0), 0) AS accuracy, coalesce(avg(2 * h / nullif(s + a, 0)), 0) AS macro_f1, coalesce(max(h / nullif(a, 0)) FILTER (cl = 'smishing'), 0) AS precision, coalesce(max(h / nullif(s, 0)) FILTER (cl = 'smishing'), 0) AS recall, coalesce(max(2 * h / nullif(s + a, 0)) FILTER (cl = 'smishing'), 0) AS f1 FROM k GROUP BY draw) "
    + "SELECT metric, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, round(avg(value), 6) AS mean FROM (UNPIVOT m ON accuracy, macro_f1, precision, recall, f1 INTO NAME metric VALUE value) GROUP BY metric",
    "bootstrap_ci": _P + ", g AS (SELECT source, count(*) FILTER (y = 'smishing') AS s, count(*) FILTER (y = 'smishing' AND pred = y) AS h FROM p GROUP BY source), d AS (SELECT draw, s, h, ('0x' || substr(md5('42/' || source || '/' || draw), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM g, generate_series(1, 2000) x(draw) WHERE s > 0), "
    + f"w AS (SELECT draw, {' + '.join(_POIS)} AS k, s, h FROM d), r AS (SELECT draw, coalesce(sum(k * h) / nullif(sum(k * s), 0), 0) AS r FROM w GROUP BY draw) SELECT round(quantile_cont(r, 0.025), 6) AS lo, round(quantile_cont(r, 0.975), 6) AS hi, round(avg(r), 6) AS mean, count(*) AS draws FROM r",
    "repeated_summary": _P + ", r AS (SELECT doc_id % 6 AS seed, avg((mc = 'smishing')::INT) - avg((pred = 'smishing')::INT) AS gain FROM o WHERE y = 'smishing' GROUP BY 1) SELECT round(avg(gain), 6) AS mean_gain, count(*) FILTER (gain > 0) AS better, round(min(gain), 6) AS least, round(max(gain), 6) AS most FROM r",
    "before_after": _P + ", t AS (SELECT 'before' AS run, 0.5::DOUBLE AS t UNION ALL SELECT 'after', 0.35::DOUBLE) SELECT run, count(*) FILTER (y = 'smishing' AND pt >= t) AS tp, count(*) FILTER (y <> 'smishing' AND pt >= t) AS fp, count(*) FILTER (y = 'smishing' AND pt < t) AS fn, count(*) FILTER (y <> 'smishing' AND pt < t) AS tn, round(count(*) FILTER ((y = 'smishing') = (pt >= t)) / count(*), 6) AS accuracy, count(*) FILTER ((y = 'smishing') <> (pt >= t)) AS errors FROM o, t GROUP BY run",
    "decided_classes": _P + "SELECT doc_id, CASE WHEN pt >= 0.54::DOUBLE THEN 'TARGET' ELSE 'OTHER' END AS decision, round(pt, 4) AS p FROM o",
}
