"""Learning on texts with pyspark.ml: a ladder of models, calibration, cross-validation by folds, explanations.

Every model is fitted on a frame with ``text`` and ``y`` (class name) and adds ``proba`` (array in the order of the classes, sorted by
name) and ``pred``.  Term weights follow pyspark.ml's IDF, ln((n + 1) / (df + 1)); the long form in operators.similarity has
the other one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernspan.functions import text as T
from fernspan.operators import bayes, metrics
from fernspan.session import keep, ship

FEATURES = 1 << 14
#: Words of two characters and more, lower-cased.
WORD = r"(?U)(\b\w\w+\b)"
WORDS_OF = lambda t: F.regexp_extract_all(F.lower(t), F.lit(WORD), 1)


def prepared(df: DataFrame, chars: bool = True) -> DataFrame:
    """Adds word and (if a model wants them) character n-gram arrays; null text is empty."""
    t = F.coalesce("text", F.lit(""))
    out = df.withColumn("words", WORDS_OF(t))
    n = F.size("words")
    # the words beside themselves, one on: each position once, not the whole text for each
    pairs = F.zip_with(F.slice("words", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    out = out.withColumn("word_pairs", F.concat("words", pairs))
    return out.withColumn("chars", T.char_wb(t, 2, 4)) if chars else out


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the counts of term arrays by cell (``words_cells`` for ``words``), and drops all arrays but the words: a text has ten times as many terms as cells
    that are worth a number, and readers hold some thousand rows of a table at a time."""
    for c in columns:
        df = HashingTF(inputCol=c, outputCol=f"{c}_cells", numFeatures=FEATURES).transform(df)
    return df.drop("word_pairs", "chars")


def tfidf_stages(column: str, out: str, idf: bool = True, cells: bool = False) -> list:
    """cells: from what counted() gives, otherwise from arrays of terms."""
    tf = HashingTF(inputCol=column, outputCol=f"{out}_tf", numFeatures=FEATURES)
    source, first = (f"{column}_cells", []) if cells else (f"{out}_tf", [tf])
    if not idf:
        return [*first, Normalizer(inputCol=source, outputCol=out, p=float("inf"))]
    return [*first, IDF(inputCol=source, outputCol=f"{out}_idf", minDocFreq=2), Normalizer(inputCol=f"{out}_idf", outputCol=out)]


def of_terms(model: PipelineModel, column: str) -> PipelineModel:
    """A model that was fitted on counts by cell, for arrays of terms."""
    return PipelineModel(stages=[HashingTF(inputCol=column, outputCol=f"{column}_cells", numFeatures=FEATURES), *model.stages])


def labelled(df: DataFrame, classes: list[str]) -> DataFrame:
    """Adds the class number (by sorted name) and balanced weights n / (classes * rows of the class)."""
    number = reduce(lambda e, kv: F.when(F.col("y") == kv[1], float(kv[0])).otherwise(e), enumerate(classes), F.lit(None).cast("double"))
    w = metrics.class_weights(df, "y").select(F.col("y").alias("__y"), "weight")
    return df.withColumn("label", number).join(F.broadcast(w), F.col("y") == F.col("__y")).drop("__y").filter("label IS NOT NULL")


def ladder(cells: bool = False) -> dict[str, Pipeline]:
    """The four rungs: counts with naive Bayes, word TF-IDF and word + character TF-IDF with logistic regression, character TF-IDF with a linear SVM.

    cells: on frames that counted() has gone over, with equal results.
    """
    lr = lambda: LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", regParam=0.01, maxIter=40)
    both = [*tfidf_stages("word_pairs", "wv", cells=cells), *tfidf_stages("chars", "cv", cells=cells), VectorAssembler(inputCols=["wv", "cv"], outputCol="features")]
    counts = "words_cells" if cells else "features"
    tf = [] if cells else [HashingTF(inputCol="words", outputCol=counts, numFeatures=FEATURES)]
    return {
        "nb_counts": Pipeline(stages=[*tf, NaiveBayes(featuresCol=counts, labelCol="label", modelType="multinomial", smoothing=1.0)]),
        "nb_complement": Pipeline(stages=[*tf, NaiveBayes(featuresCol=counts, labelCol="label", modelType="complement", smoothing=1.0)]),
        "lr_word": Pipeline(stages=[*tfidf_stages("word_pairs", "features", cells=cells), lr()]),
        "lr_word_char": Pipeline(stages=[*both, lr()]),
        "svm_char": Pipeline(stages=[*tfidf_stages("chars", "features", cells=cells), OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01), featuresCol="features", labelCol="label", weightCol="weight")]),
    }


def tree_ladder(columns: list[str]) -> dict[str, Pipeline]:
    """Tabular models on numeric columns (two classes for boosting)."""
    va = lambda: VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    return {
        "tree": Pipeline(stages=[va(), DecisionTreeClassifier(maxDepth=4, seed=1)]),
        "forest": Pipeline(stages=[va(), RandomForestClassifier(numTrees=20, maxDepth=5, seed=1)]),
        "boosting": Pipeline(stages=[va(), GBTClassifier(maxIter=10, maxDepth=3, seed=1)]),
        "logistic": Pipeline(stages=[va(), LogisticRegression(maxIter=30)]),
        "mlp": Pipeline(stages=[va(), MultilayerPerceptronClassifier(layers=[len(columns), 8, 2], maxIter=30, seed=1)]),
    }


def scored(model: PipelineModel, df: DataFrame, classes: list[str]) -> DataFrame:
    """Adds proba and pred; a model without probabilities (the SVM) gets them from calibrated() instead, here 1.0 for its answer."""
    out = model.transform(df)
    names = F.array(*map(F.lit, classes))
    pred = F.get(names, F.col("prediction").cast("int"))
    if "probability" in out.columns:
        proba = vector_to_array("probability")
        best = F.array_position(proba, F.array_max(proba))
        return out.withColumn("proba", proba).withColumn("pred", F.get(names, (best - 1).cast("int")))
    return out.withColumn("pred", pred).withColumn("proba", F.transform(names, lambda c: F.when(c == pred, 1.0).otherwise(0.0)))


def fold_predictions(build: Callable[[], Pipeline], df: DataFrame, classes: list[str], fold: str, k: int) -> DataFrame:
    """Out-of-fold predictions: each fold is scored by a model of the others."""
    parts = []
    for i in range(k):
        model = build().fit(df.filter(F.col(fold) != i))
        parts.append(scored(model, df.filter(F.col(fold) == i), classes))
    return reduce(DataFrame.unionByName, parts)


def calibrated(df: DataFrame, classes: list[str], margins: str = "rawPrediction") -> tuple[list[tuple[float, float]], Callable[[DataFrame], DataFrame]]:
    """Platt curves, one for each class, on out-of-fold margins; the function turns margins into probabilities that sum to 1."""
    curves = []
    for i, _ in enumerate(classes):
        d = df.select(F.array(F.get(vector_to_array(margins), F.lit(i))).alias("m"), (F.col("label") == i).cast("double").alias("label"))
        lr = LogisticRegression(featuresCol="v", labelCol="label", maxIter=30)
        d = VectorAssembler(inputCols=["x"], outputCol="v").transform(d.select(F.get("m", F.lit(0)).alias("x"), "label"))
        m = lr.fit(d)
        curves.append((float(m.coefficients[0]), float(m.intercept)))

    def apply(x: DataFrame) -> DataFrame:
        raw = vector_to_array(margins)
        ps = [1 / (1 + F.exp(-(F.get(raw, F.lit(i)) * a + b))) for i, (a, b) in enumerate(curves)]
        total = reduce(lambda p, q: p + q, ps)
        proba = F.array(*(p / total for p in ps))
        names = F.array(*map(F.lit, classes))
        return x.withColumn("proba", proba).withColumn("pred", F.get(names, (F.array_position("proba", F.array_max("proba")) - 1).cast("int")))

    return curves, apply


def soft_vote(frames: list[DataFrame], key: str) -> DataFrame:
    """Mean probabilities of several models' predictions of the same rows."""
    every = reduce(DataFrame.unionByName, [f.select(key, "y", F.posexplode("proba").alias("i", "p")) for f in frames])
    mean = every.groupBy(key, "y", "i").agg(F.avg("p").alias("p"))
    return mean.groupBy(key, "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("proba"))


def grid(alphas: list[float], words: list[int], pairs: list[int]) -> list[bayes.Config]:
    """Every combination of smoothing and least document frequencies of words and of word pairs."""
    return [bayes.Config(a, {"word": w, "pair": p}) for w in words for p in pairs for a in alphas]


def grid_search(df: DataFrame, classes: list[str], key: str, fold: str, configs: list[bayes.Config]) -> DataFrame:
    """Per configuration: mean and deviation over the folds of naive Bayes' macro F1 out of fold. All folds and configurations share one table of counts. df has words."""
    rows = df.select(F.col(key).alias("doc"), F.col(fold).alias("fold"), "y", "words")
    p = bayes.words_out_of_fold(rows, [], classes, configs, ["config", "fold", "y", "pred"], pairs=True)
    each = metrics.summary(p, ["config", "fold"])
    facts = F.array(*(F.struct(F.lit(c.alpha).alias("alpha"), F.lit(c.least.get("word", 1)).alias("min_df"), F.lit(c.least.get("pair", 1)).alias("min_df_pairs")) for c in configs))
    out = each.groupBy("config").agg(F.avg("macro_f1").alias("macro_f1"), F.stddev_pop("macro_f1").alias("deviation"), F.count("*").alias("folds"), F.sum("n").alias("n"))
    return out.withColumn("c", F.get(facts, F.col("config"))).select("c.alpha", "c.min_df", "c.min_df_pairs", "macro_f1", "deviation", "folds", "n")


def top_features(df: DataFrame, weights: np.ndarray, classes: list[str], column: str, n: int) -> DataFrame:
    """The words with the largest weight of each class: words are hashed as the model does and looked up."""
    words = df.select(F.explode(F.array_distinct(column)).alias("word")).groupBy("word").agg(F.count("*").alias("df")).filter("df >= 2").select("word")
    names = list(classes)
    ship(df.sparkSession)

    def look(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            at = cells([w.encode() for w in p["word"]], weights.shape[1])
            for i, c in enumerate(names):
                yield pd.DataFrame({"class": c, "word": p["word"], "weight": weights[i][at]})

    w = Window.partitionBy("class").orderBy(F.desc("weight"), "word")
    pairs = words.mapInPandas(look, "class string, word string, weight double")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def cells(terms: list[bytes], size: int) -> np.ndarray:
    """The cells that HashingTF puts terms into: 32-bit MurmurHash3 of their bytes under seed 42, for all terms side by side."""
    n = np.array([len(t) for t in terms], np.int64)
    width = max(int(n.max(initial=0)) + 3, 4) // 4 * 4
    data = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in terms), np.uint8).reshape(len(terms), width)
    blocks = data.view("<u4")
    h = np.full(len(terms), 42, np.uint32)

    def scrambled(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)

    for j in range(width // 4):
        k = scrambled(blocks[:, j])
        mixed = h ^ k
        mixed = ((mixed << np.uint32(13)) | (mixed >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        whole, tail = n >= 4 * j + 4, (n > 4 * j) & (n < 4 * j + 4)
        h = np.where(whole, mixed, np.where(tail, h ^ k, h))
    h ^= n.astype(np.uint32)
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(times)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % size


def _kept(n: int, draws: int, key: object, seed: int) -> np.ndarray:
    """Which of n words each variant keeps: all in the first, else all but a random number of random ones."""
    r = np.random.default_rng([seed, zlib.crc32(str(key).encode())])
    out = np.ones((draws, n), bool)
    for row in out[1:]:
        row[r.choice(n, r.integers(1, n + 1), replace=False)] = False
    return out


def _fitted(names: np.ndarray, first: np.ndarray, kept: np.ndarray, y: np.ndarray) -> tuple[list[str], list[float]]:
    """A text's distinct words, those that speak most for the class first, and their weights in a weighted ridge regression."""
    if len(names) == 1:
        return [str(names[0])], [1.0]
    x = kept.astype(float)
    w = np.sqrt(np.exp(-((100 * (1 - np.sqrt(x.mean(1)))) ** 2) / 25.0**2))
    mean = w / w.sum()
    a, b = (x - mean @ x) * np.sqrt(w)[:, None], (y - mean @ y) * np.sqrt(w)
    draws, n = x.shape
    beta = np.linalg.solve(a.T @ a + np.eye(n), a.T @ b) if n <= draws else a.T @ np.linalg.solve(a @ a.T + np.eye(draws), b)
    order = np.lexsort((first, -beta))
    return [str(names[i]) for i in order], [float(beta[i]) for i in order]


def _spread(df: DataFrame, key: str) -> DataFrame:
    """(key, tokens): the words between blanks of every text that has any; few texts make much work, so they are spread."""
    words = T.words(F.coalesce("text", F.lit("")))
    return df.select(key, words.alias("tokens")).filter(F.size("tokens") > 0).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


class LinearText:
    """A hashed TF-IDF text model with a linear end, as arrays: term weights by cell, coefficients by class and cell."""

    def __init__(self, model: PipelineModel):
        tf, idf, norm, lr = model.stages
        self.size, self.idf = tf.getNumFeatures(), idf.idf.toArray()
        self.coefficients, self.intercepts = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
        self.pairs = tf.getInputCol() == "word_pairs"

    @staticmethod
    def fits(model: PipelineModel) -> bool:
        kinds = [type(s).__name__ for s in model.stages]
        if kinds != ["HashingTFModel" if kinds[:1] == ["HashingTFModel"] else "HashingTF", "IDFModel", "Normalizer", "LogisticRegressionModel"]:
            return False
        tf, _, norm, lr = model.stages
        return tf.getInputCol() in ("words", "word_pairs") and not tf.getBinary() and norm.getP() == 2.0 and lr.coefficientMatrix.numRows > 1

    def probabilities(self, pieces: list[list[str]], kept: np.ndarray, rows: int = 64) -> np.ndarray:
        """(variants x classes): pieces are the words inside each token, kept says which tokens a variant has.

        Terms are added up by cell from an incidence of variants and tokens; a pair of words spans whatever was left out
        between them, so pairs of tokens that meet in some variant are hashed once for all of them.
        """
        full = np.array([i for i, p in enumerate(pieces) if p], np.int64)
        if not len(full):
            return np.tile(_softmax(self.intercepts[None]), (len(kept), 1))
        inner = [[*pieces[i], *(" ".join(ab) for ab in zip(pieces[i], pieces[i][1:]) if self.pairs)] for i in full]  # noqa: B905
        term_of, at = np.unique([t for p in inner for t in p], return_inverse=True)
        own_cell = cells([t.encode() for t in term_of.tolist()], self.size)[at]
        lens = np.array([len(p) for p in inner])
        first_term = np.concatenate([[0], np.cumsum(lens)])
        # tokens as numbers of their first and last word, so that equal pairs are hashed once
        ends, _number = np.unique([pieces[i][0] for i in full] + [pieces[i][-1] for i in full], return_inverse=True)
        head, tail = _number[: len(full)], _number[len(full) :]
        known: dict[int, int] = {}
        out = np.empty((len(kept), len(self.intercepts)))
        for lo in range(0, len(kept), rows):
            part = kept[lo : lo + rows][:, full]
            r, c = np.nonzero(part)
            n = lens[c]
            inside = np.repeat(first_term[c] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            row, cell = [np.repeat(r, n)], [own_cell[inside]]
            if self.pairs and len(r) > 1:
                meet = r[1:] == r[:-1]
                key = tail[c[:-1][meet]] * len(ends) + head[c[1:][meet]]
                distinct, place = np.unique(key, return_inverse=True)
                fresh = [k for k in distinct.tolist() if k not in known]
                if fresh:
                    a, b = np.divmod(np.array(fresh), len(ends))
                    known.update(zip(fresh, cells([f"{ends[x]} {ends[y]}".encode() for x, y in zip(a.tolist(), b.tolist(), strict=True)], self.size).tolist(), strict=True))
                row.append(r[1:][meet])
                cell.append(np.array([known[k] for k in distinct.tolist()], np.int64)[place])
            used, place = np.unique(np.concatenate(cell), return_inverse=True)
            counts = np.bincount(np.concatenate(row) * len(used) + place, minlength=len(part) * len(used)).reshape(len(part), len(used))
            x = counts * self.idf[used]
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            x /= np.where(norm > 0, norm, 1)
            out[lo : lo + rows] = _softmax(x @ self.coefficients[:, used].T + self.intercepts)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def explained(model: PipelineModel, df: DataFrame, key: str, classes: list[str], label: str, draws: int = 1000, top: int = 5, seed: int = 7) -> DataFrame:
    """The words that speak for a class: words are left out at random, every variant is scored, a weighted line is fitted for each text.

    A word left out goes in all its places, wherever in the text; with more words than draws the line is fitted in the space of the
    draws, and which words a variant lacks follows from the key. A text of one word has that word as its flag. Keys are
    taken to be distinct.  Hashed TF-IDF with a logistic end is scored as matrices, text by text in one task each; its
    arrays (cells x classes, whatever the input) go along.  Any other model scores variants as rows.
    """
    if not LinearText.fits(model):
        return explained_by_rows(model, df, key, classes, label, draws, top, seed)
    ship(df.sparkSession)
    base = _spread(df, key)
    words = base.select(key, "tokens", F.transform("tokens", WORDS_OF).alias("pieces"))
    linear, kind, which = LinearText(model), dict(df.dtypes)[key], classes.index(label)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for k, tokens, pieces in zip(p[key], p["tokens"], p["pieces"], strict=True):
                names, first, where = np.unique(np.asarray(list(tokens), object).astype(str), return_index=True, return_inverse=True)
                kept = _kept(len(names), draws, k, seed)
                y = linear.probabilities([list(x) for x in pieces], kept[:, where])[:, which] if len(names) > 1 else np.zeros(draws)
                rows.append((k, *_fitted(names, first, kept, y)))
            yield pd.DataFrame(rows, columns=[key, "words", "weights"])

    out = words.mapInPandas(explain, f"{key} {kind}, words array<string>, weights array<double>")
    return out.select(key, T.red_flags(F.col("words"), F.col("weights"), top).alias("flags"))


def explained_by_rows(model: PipelineModel, df: DataFrame, key: str, classes: list[str], label: str, draws: int = 1000, top: int = 5, seed: int = 7) -> DataFrame:
    """The same for any model: variants are texts, scored as rows of one frame; only scores travel back to their text."""
    ship(df.sparkSession)
    base = _spread(df, key)
    kind = dict(df.dtypes)[key]

    def vary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for k, tokens in zip(p[key], p["tokens"], strict=True):
                tokens = np.asarray(list(tokens), object)
                _, where = np.unique(tokens.astype(str), return_inverse=True)
                kept = _kept(where.max() + 1, draws, k, seed)
                for at in range(0, draws, 50):
                    texts = [" ".join(tokens[row[where]]) for row in kept[at : at + 50]]
                    yield pd.DataFrame({key: k, "draw": np.arange(at, at + len(texts)), "text": texts})

    varied = base.mapInPandas(vary, f"{key} {kind}, draw int, text string")
    s = scored(model, prepared(varied), classes).select(key, "draw", F.get("proba", F.lit(classes.index(label))).alias("p"))
    scores = s.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "p"))), lambda x: x["p"]).alias("ps"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for k, tokens, ps in zip(p[key], p["tokens"], p["ps"], strict=True):
                names, first = np.unique(np.asarray(list(tokens), object).astype(str), return_index=True)
                rows.append((k, *_fitted(names, first, _kept(len(names), draws, k, seed), np.asarray(list(ps)))))
            yield pd.DataFrame(rows, columns=[key, "words", "weights"])

    out = base.join(scores, key).mapInPandas(fit, f"{key} {kind}, words array<string>, weights array<double>")
    return out.select(key, T.red_flags(F.col("words"), F.col("weights"), top).alias("flags"))


def numeric_regression(df: DataFrame, y: str, columns: list[str]) -> DataFrame:
    """Coefficients of a linear regression on several columns, one row each."""
    d = VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna(subset=[y, *columns]))
    m = LinearRegression(featuresCol="features", labelCol=y, solver="normal").fit(d)
    rows = [("intercept", float(m.intercept)), *zip(columns, map(float, m.coefficients), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def importances(model: PipelineModel, columns: list[str], top: int = 5) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(((c, float(v)) for c, v in zip(columns, values, strict=True)), key=lambda x: (-x[1], x[0]))[:top]


def one_rules(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """For every attribute the rule 'value gives its most frequent label', with the share of rows that it gets right."""
    long = df.select(label, F.expr(f"stack({len(attributes)}, {', '.join(f'{chr(39)}{a}{chr(39)}, cast({a} AS string)' for a in attributes)}) AS (attribute, value)"))
    c = long.groupBy("attribute", "value", label).agg(F.count("*").alias("n"))
    best = c.groupBy("attribute", "value").agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("answer"), F.max("n").alias("hits"), F.sum("n").alias("n"))
    w = Window.partitionBy("attribute")
    return best.withColumn("accuracy", F.sum("hits").over(w) / F.sum("n").over(w))


