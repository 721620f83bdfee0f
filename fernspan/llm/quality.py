"""Document quality from weak labels: expectation-maximisation over overlapping heuristics, then a hashed linear scorer.

Ten heuristic labellers, all column expressions, vote good (1), bad (-1) or abstain (0) on every document.  Only the counts
of vote patterns (3^10 at most, whatever the input) reach the driver, where expectation-maximisation (Dawid and Skene's
model) estimates each labeller's votes given the true class and hence a posterior for every pattern.  Documents of a bounded
sample (``TRAIN_ROWS``, lowest by hash) then train a logistic scorer on hashed features (words, word shapes, pairs of
shapes, repeats) with the posteriors as labels; the scorer rates every whole text.

Defined results: null and empty texts have no words: they are bad (score 0, keep false); rows that repeat a doc_id or have none
are rated one by one; very long texts are read whole; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernspan.session import keep, lean, ship

TRAIN_ROWS = 8_000
BUCKETS = 1 << 16
KEEP = 0.5
REMEMBERED = 300_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def voted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with each labeller's vote, v_<name>; a text without words gets bad ones from all that can tell.

    What several labellers look at is computed once, below them: word hashes, lines, and the text without its plain letters.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("__h", F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    d = d.withColumn("__rest", F.translate(text, "abcdefghijklmnopqrstuvwxyz ", "")).withColumn("__lines", F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.xxhash64(x)))
    size = {"upper": _UPPER, "bang": "!", "field": "|<>{}\\", "symbol": "$%&#*@^~", "mark": "|<>{}\\$%&#*@^~!?;:=+", "digit": "0123456789"}
    n, rest = F.size("__h"), F.length("__rest")
    again = F.size(F.filter(F.zip_with("__h", F.slice("__h", 2, F.greatest(n - 1, F.lit(0))), lambda x, y: x == y), lambda same: same))
    d = d.select("doc_id", "text", n.alias("n"), F.length(text).alias("chars"), F.size(F.array_distinct("__h")).alias("distinct"), again.alias("again"), F.size("__lines").alias("lines"), F.size(F.array_distinct("__lines")).alias("own_lines"), *((rest - F.length(F.translate("__rest", x, ""))).alias(k) for k, x in size.items()))
    c = F.col
    vote = lambda bad, good: F.when(c("n") == 0, -1).when(bad, -1).when(good, 1).otherwise(0).cast("byte")
    word = lambda k: c(k) / F.greatest("n", F.lit(1))
    # a text's vocabulary grows about as a power of its length
    spread = c("distinct") / F.pow(F.greatest("n", F.lit(1)).cast("double"), F.lit(0.75))
    named = {
        "length": vote(c("n") < 1, c("n") >= 50),
        "spread": vote((c("n") >= 20) & (spread < 0.7), (c("n") >= 20) & (spread > 1)),
        "repeats": vote(word("again") > 0.1, word("again") < 0.03),
        "capitals": vote(c("upper") > 0.2 * c("chars"), c("upper") < 0.08 * c("chars")),
        "shouting": vote(word("bang") > 0.1, word("bang") < 0.02),
        "fields": vote(word("field") > 0.1, word("field") < 0.01),
        "symbols": vote(word("symbol") > 0.2, word("symbol") < 0.02),
        "marks": vote(c("mark") > 0.04 * c("chars"), c("mark") < 0.01 * c("chars")),
        "digits": vote(c("digit") > 0.2 * c("chars"), c("digit") < 0.05 * c("chars")),
        "lines": vote((c("lines") >= 4) & (c("own_lines") < 0.7 * c("lines")), c("own_lines") == c("lines")),
    }
    return d.select("doc_id", "text", *(v.alias(f"v_{k}") for k, v in named.items()))


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of the good class for every row of patterns (votes -1, 0, 1), by expectation-maximisation.

    It begins with every bad vote taking half off a high start, and ends with each labeller's accuracies in either class in theta.
    """
    if not len(patterns):
        return np.zeros(0)
    onehot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    # a bad vote is rarer and says more than a good one, so one or two of them outweigh the rest at the start
    post = np.clip(0.95 - 0.5 * (patterns == -1).sum(1), 0.05, 0.95)
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])
        prior = (w.sum(1) + 1) / (w.sum() + 2)
        theta = np.einsum("cp,plv->clv", w, onehot) + 0.5
        theta /= theta.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("plv,clv->cp", onehot, np.log(theta))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


_SHAPE = ((re.compile(r"[A-Z]+"), "X"), (re.compile(r"[a-z]+"), "x"), (re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\x00-\x7f]+"), "u"))


class _Words(dict):
    """Word to number; buckets of the word and of its shape by number."""

    def __init__(self) -> None:
        self.table = np.zeros((REMEMBERED, 2), np.int64)

    def __missing__(self, w: str) -> int:
        shape = w[:32]
        for r, x in _SHAPE:
            shape = r.sub(x, shape)
        shape += str(min(len(w) // 6, 4))
        self[w] = i = len(self)
        if i >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i] = xxhash.xxh3_64_intdigest(w.lower(), 1) % BUCKETS, xxhash.xxh3_64_intdigest(shape, 2) % BUCKETS
        return i

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)), self.table


_words = _Words()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text: shares of its words, shapes and pairs of shapes, and steps of its repeats and length."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    ids, table = _words.of(words)
    n = len(ids)
    word, shape = table[ids].T
    pair = (shape[:-1] * 31 + shape[1:] * 17 + 5) % BUCKETS
    distinct = len(np.unique(ids)) / n**0.75
    again = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
    steps = [f"d{min(int(distinct * 10), 20)}", f"a{min(int(again * 20), 20)}", f"n{int(np.log2(n))}"]
    at, inverse = np.unique(np.concatenate([word, shape, pair]), return_inverse=True)
    share = np.bincount(inverse) / n
    extra = np.array([xxhash.xxh3_64_intdigest(s, 3) % BUCKETS for s in steps])
    return np.concatenate([at, extra]), np.concatenate([np.sqrt(share), np.ones(len(extra))])


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, rate: float = 0.3, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad."""
    w, g2, b, gb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0, 1e-6
    r = np.random.default_rng(3)
    for _ in range(epochs):
        for i in r.permutation(len(rows)):
            at, x = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + b, -30, 30)))
            d = p - y[i]
            g = d * x + l2 * w[at]
            g2[at] += g * g
            gb += d * d
            w[at] -= rate * g / np.sqrt(g2[at])
            b -= rate * d / np.sqrt(gb)
    return w.astype(np.float32), float(b)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = [features(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes() for x, _ in f], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in f], pa.binary()), b.column(1)], names=["at", "x", "y"])


def rate_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, score (0 to 1, higher is better), keep."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = voted(docs)
    cols = every.columns[2:]
    tally = keep(every.groupBy(*cols).agg(F.count("*").alias("n")), "quality_votes").toPandas()  # 3^10 rows at most
    post = em(tally[cols].to_numpy(), tally["n"].to_numpy())
    total = int(tally["n"].sum())
    schema = "doc_id long, score double, keep boolean"
    if not total:
        return spark.createDataFrame([], schema)
    known = spark.createDataFrame([(*map(int, p), float(q)) for p, q in zip(tally[cols].to_numpy(), post, strict=True)], ", ".join(f"{c} byte" for c in cols) + ", y double")
    # by id and text, so that neither null nor repeated ids come all together; equal rows count once, so that the sample is bounded
    sample = docs.filter(F.xxhash64("doc_id", "text", F.lit(5)) <= int(-(1 << 63) + (1 << 64) * min(1.0, TRAIN_ROWS / total)) - 1)
    sample = sample.dropDuplicates(["doc_id", "text"]).limit(2 * TRAIN_ROWS)
    got = voted(sample).join(F.broadcast(known), cols).select("text", "y").mapInArrow(lean(_featurise), "at binary, x binary, y double").toArrow()
    rows = [(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4")) for a, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)]
    model = spark.sparkContext.broadcast(fit_linear(rows, got.column(2).to_numpy()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = model.value
        for b in batches:
            s = []
            for t in b.column(1).to_pylist():
                at, x = features(t)
                s.append(round(float(1 / (1 + np.exp(-np.clip(w[at] @ x + bias, -30, 30)))), 6) if len(at) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([v >= KEEP for v in s], pa.bool_())], names=["doc_id", "score", "keep"])

    return docs.mapInArrow(lean(score), schema)
