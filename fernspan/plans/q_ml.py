"""Queries: learning. Labels play the classes; results are measured out of fold, so most have no oracle."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from fernspan.operators import bayes, boosting, induction, ml, sgd
from fernspan.operators import metrics as M
from fernspan.operators import split as P
from fernspan.session import keep, scratch_path, table

CLASSES = ["ham", "smishing", "spam"]


def _labelled(spark, sf, folds):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    y = F.when(F.col("toxic") == 1, "smishing").when(F.col("quality") == 0, "spam").otherwise("ham")
    d = d.select("doc_id", "text", y.alias("y"), P.bucket(F.col("doc_id"), folds).cast("int").alias("fold"))
    return d


def _texts(spark, sf, chars=False):
    """Labelled texts with their words and word pairs in three folds; chars: cells of words, word pairs and character n-grams instead of arrays."""
    d = ml.labelled(ml.prepared(_labelled(spark, sf, 3), chars), CLASSES)
    if chars:
        d = ml.counted(d, ["words", "word_pairs", "chars"]).drop("words", "text")
    return keep(d, "ml_texts")


def _word_cells(spark, sf, *columns):
    """Labelled texts in three folds as counts of words and word pairs by cell, and the columns named: what the word models are fitted on, hashed once."""
    d = ml.counted(ml.labelled(ml.prepared(_labelled(spark, sf, 3), chars=False), CLASSES), ["word_pairs"])
    return keep(d.select("doc_id", "y", "fold", "label", "weight", "word_pairs_cells", *columns), "ml_cells")


def _numbers(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda p: F.length(F.regexp_replace("text", p, "")) / n
    return d.select("doc_id", F.col("quality").cast("double").alias("label"), F.log1p("n_chars").alias("size"), share("[^A-Z]").alias("upper"), share("[^!$%&#|*]").alias("marks"), share(r"[^0-9]").alias("digits"), P.bucket(F.col("doc_id"), 4).cast("int").alias("fold"))


COLUMNS = ["size", "upper", "marks", "digits"]


def ml_ladder(spark, sf):
    """Every rung, fitted on two folds and measured on the third."""
    d = _texts(spark, sf, chars=True)
    train, test = d.filter("fold <> 0"), d.filter("fold = 0")
    out = None
    for name, p in ml.ladder(cells=True).items():
        s = ml.scored(p.fit(train), test, CLASSES).select(F.lit(name).alias("model"), "y", "pred")
        out = s if out is None else out.unionByName(s)
    _, s = _descent(train, test, cells=True)
    return M.summary(keep(out.unionByName(s.select(F.lit("sgd_word").alias("model"), "y", "pred")), "ml_scores"), ["model"])


def _descent(train, test, cells=False):
    """Stochastic gradient descent on word TF-IDF: the model, and scores of the test rows."""
    weights = Pipeline(stages=ml.tfidf_stages("word_pairs", "features", cells=cells)).fit(train)
    sparse = F.unwrap_udt("features")
    m = sgd.fit(weights.transform(train), "doc_id", "y", sparse, ml.FEATURES, CLASSES)
    return m, sgd.scored(m, weights.transform(test), "doc_id", sparse).join(test.select("doc_id", "y"), "doc_id")


def ml_sgd(spark, sf):
    """Mean loss before each epoch of gradient descent, and macro F1 on the rows kept out."""
    d = _word_cells(spark, sf)
    m, s = _descent(d.filter("fold <> 0"), d.filter("fold = 0"), cells=True)
    curve = spark.createDataFrame([(i, x) for i, x in enumerate(m.losses)], "epoch int, loss double")
    return curve.join(F.broadcast(M.summary(s).select("n", "macro_f1")))


def ml_boosted(spark, sf):
    """Three classes by gradient boosting on six columns, measured on rows kept out."""
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda p: F.length(F.regexp_replace("text", p, "")) / n
    d = _labelled(spark, sf, 3).select("doc_id", "y", "fold", F.log1p(F.length("text")).alias("size"), share("[^A-Z]").alias("upper"), share("[^!$%&#|*]").alias("marks"), share(r"[^0-9]").alias("digits"), share(r"[^.,;:]").alias("stops"), (n / F.greatest(F.size(F.split("text", " ")), F.lit(1))).alias("word_size"))
    d = keep(d, "boosted_rows")
    m = boosting.fit(d.filter("fold <> 0"), ["size", "upper", "marks", "digits", "stops", "word_size"], "y", CLASSES)
    s = boosting.scored(m, d.filter("fold = 0"), "doc_id").join(d.select("doc_id", "y"), "doc_id")
    return M.summary(keep(s.select("y", "pred"), "boosted_scores"))


def ml_calibrated_svm(spark, sf):
    """Linear SVM margins out of fold, Platt curves on them, then Brier score and macro F1."""
    d = ml.counted(ml.labelled(ml.prepared(_labelled(spark, sf, FOLDS)), CLASSES), ["chars"])
    d = keep(d.select("doc_id", "y", "fold", "label", "weight", "chars_cells"), "ml_texts")
    oof = keep(ml.fold_predictions(lambda: ml.ladder(cells=True)["svm_char"], d, CLASSES, "fold", FOLDS).select("doc_id", "y", "label", "rawPrediction"), "ml_margins")
    # curves of one half of the rows, measured on the other
    half = P.bucket(F.col("doc_id"), 2, 9)
    _, apply = ml.calibrated(oof.filter(half == 0), CLASSES)
    s = apply(oof.filter(half == 1))
    return M.summary(s).join(F.broadcast(s.agg(M.brier(F.col("proba"), F.col("y")).alias("brier"))))


def ml_ensemble(spark, sf):
    d = _texts(spark, sf, chars=True)
    train, test = d.filter("fold <> 0"), d.filter("fold = 0")
    frames = [ml.scored(ml.ladder(cells=True)[n].fit(train), test, CLASSES).select("doc_id", "y", "proba") for n in ("nb_counts", "lr_word", "lr_word_char")]
    v = ml.soft_vote(frames, "doc_id")
    return v.select("doc_id", "y", M.argmax_class(F.col("proba")).alias("pred"))


GRID = ml.grid([0.3, 1.0, 3.0], [1, 2], [2, 3])
FOLDS = 5


def ml_grid_search(spark, sf):
    """Twelve configurations by five folds from one table of counts."""
    d = keep(ml.prepared(_labelled(spark, sf, FOLDS), chars=False).select("doc_id", "y", "fold", "words"), "grid_rows")
    g = ml.grid_search(d, CLASSES, "doc_id", "fold", GRID)
    return g.select("alpha", "min_df", "min_df_pairs", F.round("macro_f1", 6).alias("macro_f1"), F.round("deviation", 6).alias("deviation"), "folds", "n")


def oof_probabilities(spark, sf):
    """Every labelled text's class probabilities under naive Bayes on the other folds."""
    d = keep(ml.prepared(_labelled(spark, sf, FOLDS), chars=False).select(F.col("doc_id").alias("doc"), "y", "fold", "words"), "oof_rows")
    p = bayes.words_out_of_fold(d, [], CLASSES, [bayes.Config(1.0, {"word": 2})], ["doc", "fold", "y", "pred", "proba"])
    return p.select(F.col("doc").alias("doc_id"), "fold", "y", "pred", *(F.round(F.get("proba", F.lit(i)), 6).alias(c) for i, c in enumerate(CLASSES)))


def ml_trees(spark, sf):
    d = keep(_numbers(spark, sf), "ml_numbers")
    train, test = d.filter("fold <> 0"), d.filter("fold = 0")
    out = None
    for name, p in ml.tree_ladder(COLUMNS).items():
        m = p.fit(train)
        s = m.transform(test).agg(F.lit(name).alias("model"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
        out = s if out is None else out.unionByName(s)
    return out


def ml_importances(spark, sf):
    m = ml.tree_ladder(COLUMNS)["forest"].fit(_numbers(spark, sf))
    return spark.createDataFrame(ml.importances(m, COLUMNS), "feature string, importance double")


def ml_persisted(spark, sf):
    """A saved and reloaded model gives the same answers."""
    d = _numbers(spark, sf)
    m, path = ml.tree_ladder(COLUMNS)["logistic"].fit(d), scratch_path(spark, "model")
    m.write().save(path)
    again = PipelineModel.load(path)
    a, b = (x.transform(d).select("doc_id", F.col("prediction").alias(n)) for x, n in ((m, "first"), (again, "second")))
    return a.join(b, "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("second")).alias("same"))


def ml_top_features(spark, sf):
    d = _word_cells(spark, sf, "words")
    m = ml.ladder(cells=True)["lr_word"].fit(d)
    return ml.top_features(d, m.stages[-1].coefficientMatrix.toArray(), CLASSES, "words", 10)


def lime_tokens(spark, sf):
    """Red-flag words of every target document, all its words and 1,000 variants each, under the word model."""
    d = _texts(spark, sf)
    m = ml.ladder()["lr_word"].fit(d)
    return ml.explained(m, d.filter("y = 'smishing'").select("doc_id", "text"), "doc_id", CLASSES, "smishing")


def one_rule(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", "source", "quality")
    return ml.one_rules(d, ["lang", "source"], "quality").select("attribute", "value", "answer", "hits", "n", F.round("accuracy", 6).alias("accuracy"))


def cn2_rules(spark, sf):
    """Rules for the quality of documents from six attributes."""
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda p: F.length(F.regexp_replace("text", p, "")) / n
    level = lambda c, a, b: F.when(c < a, "low").when(c < b, "middle").otherwise("high")
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumns({"size": level(F.length("text"), 200, 1000), "upper": level(share("[^A-Z]"), 0.03, 0.2), "marks": level(share("[^!$%&#|*]"), 0.002, 0.05), "digits": level(share("[^0-9]"), 0.005, 0.05)})
    columns = ["lang", "source", "size", "upper", "marks", "digits"]
    return induction.table_of(induction.induce(d.select(*columns, "quality"), columns, "quality"), d)


def linear_model(spark, sf):
    r = ml.numeric_regression(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return r.select("term", F.round("coefficient", 2).alias("coefficient"))


QUERIES = {f.__name__: f for f in (ml_ladder, ml_sgd, ml_boosted, ml_calibrated_svm, ml_ensemble, ml_grid_search, oof_probabilities, ml_trees, ml_importances, ml_persisted, ml_top_features, lime_tokens, one_rule, cn2_rules, linear_model)}


def bayes_sql(rows: str, terms: str, keys: list[str], configs: list[bayes.Config]) -> str:
    """CTEs up to ``oof`` (*keys, doc, fold, y, config, a0.. log-scores, pred); rows and terms: queries for what bayes.out_of_fold takes."""
    k = "".join(f"{x}, " for x in keys)
    of = lambda t: "".join(f"{t}.{x}, " for x in keys)
    on = lambda a, b: "".join(f"{a}.{x} = {b}.{x} AND " for x in keys)
    each = lambda f: ", ".join(f(i, c) for i, c in enumerate(CLASSES))
    values = ", ".join(f"({i}, {c.alpha:f}::DOUBLE, {c.least.get('word', 1)}, {c.least.get('pair', 1)})" for i, c in enumerate(configs))
    enough = "tr.df >= CASE tr.kind WHEN 'word' THEN cf.mw ELSE cf.mp END"
    best = "CASE " + " ".join(f"WHEN a{i} >= greatest(a0, a1, a2) THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
    return f"""r AS MATERIALIZED ({rows}), t AS MATERIALIZED ({terms}), cf(config, alpha, mw, mp) AS (VALUES {values}), gs AS (SELECT DISTINCT {k}fold AS g FROM r),
tr AS MATERIALIZED (SELECT {of("t")}g, kind, term, {each(lambda i, c: f"coalesce(sum(c) FILTER (y = '{c}'), 0) AS n{i}")}, count(*) AS df FROM t JOIN gs ON {on("t", "gs")}t.fold <> g GROUP BY ALL),
sz AS (SELECT {of("tr")}g, config, any_value(alpha) AS alpha, count(*) AS v, {each(lambda i, c: f"sum(n{i}) AS z{i}")} FROM tr JOIN cf ON {enough} GROUP BY ALL),
pr AS (SELECT {of("r")}g, {each(lambda i, c: f"CASE WHEN count(*) FILTER (y = '{c}') > 0 THEN ln(count(*) FILTER (y = '{c}') / count(*)) ELSE '-inf'::DOUBLE END AS p{i}")} FROM r JOIN gs ON {on("r", "gs")}r.fold <> g GROUP BY ALL),
sc AS (SELECT {of("t")}t.doc, cf.config, {each(lambda i, c: f"sum(t.c * ln((tr.n{i} + cf.alpha) / (sz.z{i} + cf.alpha * sz.v))) AS s{i}")} FROM t JOIN tr ON {on("t", "tr")}t.fold = tr.g AND t.kind = tr.kind AND t.term = tr.term JOIN cf ON {enough} JOIN sz ON {on("t", "sz")}sz.g = t.fold AND sz.config = cf.config GROUP BY ALL),
lg AS (SELECT {of("r")}r.doc, r.fold, r.y, cf.config, {each(lambda i, c: f"pr.p{i} + coalesce(sc.s{i}, 0) AS a{i}")} FROM r CROSS JOIN cf JOIN pr ON {on("r", "pr")}pr.g = r.fold LEFT JOIN sc ON {on("r", "sc")}sc.doc = r.doc AND sc.config = cf.config),
oof AS MATERIALIZED (SELECT *, {best} AS pred FROM lg)"""


def fold_f1_sql(keys: list[str]) -> str:
    """CTE ``f1`` (*keys, config, fold, n, macro_f1) of ``oof``."""
    k = "".join(f"{x}, " for x in keys)
    one = f"SELECT {k}config, fold, cl, 2.0 * count(*) FILTER (y = cl AND pred = cl) / nullif(count(*) FILTER (y = cl) + count(*) FILTER (pred = cl), 0) AS f FROM oof, unnest({list(CLASSES)}) u(cl) GROUP BY ALL"
    return f"f1 AS (SELECT {k}config, fold, any_value(n) AS n, avg(f) AS macro_f1 FROM ({one}) JOIN (SELECT {k}config, fold, count(*) AS n FROM oof GROUP BY ALL) USING ({k}config, fold) GROUP BY ALL)"


_Y = "CASE WHEN toxic = 1 THEN 'smishing' WHEN quality = 0 THEN 'spam' ELSE 'ham' END"
_BUCKET = lambda key, k, seed: f"(('0x' || left(md5('{seed}/' || {key}), 8))::BIGINT % {k})"
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}')"
_D = f"d AS MATERIALIZED (SELECT doc_id AS doc, {_BUCKET('doc_id', 5, 42)} AS fold, {_Y} AS y, {_WORDS.format('text')} AS w FROM documents JOIN labels USING (doc_id))"
_ONES = "SELECT doc, fold, y, 'word' AS kind, unnest(w) AS term FROM d"
_PAIRS = "SELECT doc, fold, y, 'pair', unnest(list_transform(generate_series(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1])) FROM d WHERE len(w) > 1"
_COUNT = lambda q: f"SELECT doc, fold, y, kind, term, count(*) AS c FROM ({q}) GROUP BY ALL"
_L = "d AS (SELECT lang, source, quality FROM documents JOIN labels USING (doc_id)), l AS (SELECT 'lang' AS attribute, lang AS value, quality FROM d UNION ALL SELECT 'source', source, quality FROM d)"
ORACLES = {
    "ml_grid_search": f"WITH {_D}, {bayes_sql('SELECT doc, fold, y FROM d', _COUNT(_ONES + ' UNION ALL ' + _PAIRS), [], GRID)}, {fold_f1_sql([])} SELECT alpha, mw AS min_df, mp AS min_df_pairs, round(avg(macro_f1), 6) AS macro_f1, round(stddev_pop(macro_f1), 6) AS deviation, count(*) AS folds, cast(sum(n) AS BIGINT) AS n FROM f1 JOIN cf USING (config) GROUP BY alpha, mw, mp",
    "oof_probabilities": f"WITH {_D}, {bayes_sql('SELECT doc, fold, y FROM d', _COUNT(_ONES), [], [bayes.Config(1.0, {'word': 2})])}, e AS (SELECT *, greatest(a0, a1, a2) AS m FROM oof), x AS (SELECT *, exp(a0 - m) AS e0, exp(a1 - m) AS e1, exp(a2 - m) AS e2 FROM e) SELECT doc AS doc_id, fold::INT AS fold, y, pred, " + ", ".join(f"round(e{i} / (e0 + e1 + e2), 6) AS {c}" for i, c in enumerate(CLASSES)) + " FROM x",
    "one_rule": f"WITH {_L}, c AS (SELECT attribute, value, quality, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT attribute, value, arg_min(quality, -n * 10 + quality) AS answer, max(n) AS hits, cast(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL) SELECT *, round(sum(hits) OVER (PARTITION BY attribute) / sum(n) OVER (PARTITION BY attribute), 6) AS accuracy FROM b",
    "linear_model": "SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 2) AS coefficient FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 2) FROM lineitem",
    "ml_persisted": "SELECT count(*) AS n, count(*) AS same FROM documents JOIN labels USING (doc_id)",
}
