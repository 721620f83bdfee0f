"""Toxicity by class-conditional Kneser-Ney models.

One character model for toxic and one for ordinary text predict every character of a word, and its end, from the up to
``ORDER`` - 1 characters before it in the word.  Each class discounts its own counts by ``DISCOUNT`` and hands the rest to one shared backoff:
pooled counts of both classes at the same history, then continuation counts (distinct histories, not occurrences) of the
last three and of the last two characters.  An expression that one class has hardly met is thus scored from what both know
of its parts.  A word's log-likelihood ratio is the sum over its characters; a document's features are ratios per word: of
its single most toxic word, of its three most toxic distinct words, of the words beyond ``STRONG`` nats, and of the whole
text, with the length beside them.  A logistic curve, fitted on labelled rows that gave no counts, maps them to a score.

Counts come from every labelled row of the fitting folds 0 and 2 (a shuffle that grows with the input) but those the curve is
fitted on, each under its own 64-bit key.
The model, which is collected and broadcast, hence grows with the distinct grams: 16 bytes each, and 28 bytes a distinct
history.  Only the weights of the logistic curve are fitted on a bounded sample: of each class in fold 2 the rows lowest by
hash, half of them, and ``CALIBRATION_ROWS`` of both together at most (the same rule at every size).

Defined results: null or empty text scores as text without words; null doc_id rows are scored but never learned from;
several label rows of one document count as toxic if any is; null labels are not learned from; if either class is missing
from either fitting fold every score is 0; rows that repeat a doc_id are scored one by one, by their own texts; very long
texts and words are read whole; other columns pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernspan.llm.names import free
from fernspan.session import fits_broadcast, keep, lean, release, ship

ORDER = 8
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.7
DISCOUNT = 0.75
STRONG = 2.5
#: On the curve a toxic row weighs as much as so many ordinary ones, since toxic rows are the rarer.
TOXIC_WEIGHT = 3.0
#: Words, and characters of them, whose ratios a worker remembers before it starts anew.
KEPT_WORDS = 200_000
KEPT_CHARS = 8_000_000
#: Characters whose events are made at a time (a longer word is one block).
BLOCK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")
_ASCII = {i: " " for i in range(128) if not chr(i).isalnum()}


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits, whole."""
    if not text:
        return []
    t = text.lower()
    return t.translate(_ASCII).split() if t.isascii() else _WORD.findall(t)


def _hash(*columns: np.ndarray | int) -> np.ndarray:
    h = np.array([0x2545F4914F6CDD1D], np.uint64)
    for c in columns:
        h = (h ^ np.asarray(c, np.uint64)) * _P
        h = h ^ (h >> np.uint64(31))
    return h


def events(words: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """For every character of every word and for its end, in blocks: which word, hashes of the gram and its history, and its last three characters packed."""
    at = 0
    while at < len(words):
        to, size = at, 0
        while to < len(words) and (to == at or size + len(words[to]) + ORDER < BLOCK):
            size += len(words[to]) + ORDER
            to += 1
        # each word between ORDER - 1 places before it, the last of which marks the start, and a mark of its end
        flat = "".join("\0" * (ORDER - 2) + "\2" + w + "\3" for w in words[at:to])
        c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        three = c.copy()
        three[1:] |= c[:-1] << np.uint64(21)
        three[2:] |= c[:-2] << np.uint64(42)
        i = np.flatnonzero(c > 2)
        history = _hash(three[i - 1], three[i - 4], c[i - 7])
        yield at + np.cumsum(c == 2)[i] - 1, _hash(history, c[i]), history, three[i]
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by class of each batch's grams; a gram's history and lower levels follow from it and travel along."""
    for b in batches:
        seen: dict[str, list[int]] = {}
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in words_of(text):
                seen.setdefault(w, [0, 0])[y] += 1
        n = np.array(list(seen.values()), np.int64).reshape(-1, 2)
        for rows, *e in events(list(seen)):
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.uint64).view(np.int64)) for x in e), pa.array(n[rows, 0]), pa.array(n[rows, 1])], names=["g", "c", "s", "n0", "n1"])


def _sorted(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys (first column, long) in order, and the other columns as rows of one array."""
    t = df.toArrow()
    k = t.column(0).to_numpy().view(np.uint64)
    order = np.argsort(k)
    return k[order], np.stack([t.column(i).to_numpy().astype(np.float32)[order] for i in range(1, t.num_columns)])


def _by(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _sorted: the columns summed by key."""
    k, at = np.unique(keys, return_inverse=True)
    return k, np.stack([np.bincount(at, c, len(k)).astype(np.float32) for c in columns])


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The columns at the keys, 0 where a key was never counted."""
    known, columns = table
    i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[i] == keys, columns[:, i], 0)


class Model:
    """Counts under their own keys, and the log-likelihood ratios of words under them.

    grams: (gram; n0, n1). histories: (history; n0, n1, types0, types1, types). threes: (last three characters; distinct histories before them).
    """

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], histories: tuple[np.ndarray, np.ndarray], threes: tuple[np.ndarray, np.ndarray]):
        self.tables = grams, histories, threes
        # the lower levels follow from the threes: after two characters, the last two, and after one
        s, n = threes[0], threes[1][0]
        twos = _by(s & np.uint64((1 << 42) - 1), n)
        self.lower = _by(s >> np.uint64(21), n, np.ones(len(s))), twos, _by(twos[0] >> np.uint64(21), twos[1][0], np.ones(len(twos[0])))
        self.forget()

    def forget(self) -> None:
        self.ids = _Ids()
        self.llr = np.zeros(0)
        self.chars = 0

    def __reduce__(self) -> tuple:
        return Model, self.tables

    def ratios(self, words: list[str]) -> np.ndarray:
        (grams, histories, threes), (after_two, twos, after_one) = self.tables, self.lower
        out = np.zeros(len(words))
        for rows, g, c, s in events(words):
            n0, n1 = _find(grams, g)
            c0, c1, types0, types1, types = _find(histories, c)
            two = s & np.uint64((1 << 42) - 1)
            p = np.full(len(rows), 1 / 256)
            for n, (total, kinds) in ((_find(twos, two)[0], _find(after_one, two >> np.uint64(21))), (_find(threes, s)[0], _find(after_two, s >> np.uint64(21))), (n0 + n1, (c0 + c1, types))):
                d = np.maximum(total, 1)
                p = np.where(total > 0, np.maximum(n - DISCOUNT, 0) / d + np.minimum(1, DISCOUNT * kinds / d) * p, p)
            ps = []
            for n, total, kinds in ((n0, c0, types0), (n1, c1, types1)):
                d = np.maximum(total, 1)
                ps.append(np.where(total > 0, np.maximum(n - DISCOUNT, 0) / d + np.minimum(1, DISCOUNT * kinds / d) * p, p))
            out += np.bincount(rows, np.log(np.maximum(ps[1], 1e-12)) - np.log(np.maximum(ps[0], 1e-12)), len(words))
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        if len(self.ids) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.forget()
        at = [np.array(list(map(self.ids.__getitem__, words_of(t))), np.int64) for t in texts]
        if new := self.ids.new:
            self.llr = np.concatenate([self.llr, self.ratios(new)])
            self.chars += sum(map(len, new))
            self.ids.new = []
        out = np.zeros((len(texts), 5))
        for i, a in enumerate(at):
            if len(a):
                x = self.llr[a]
                distinct = self.llr[np.unique(a)]
                top = np.sort(np.partition(distinct, -3)[-3:] if len(distinct) > 3 else distinct)
                out[i] = top[-1], top.sum() / 3, np.log1p(np.maximum(distinct - STRONG, 0).sum()), x.mean(), np.log(len(a))
        return out


class _Ids(dict):
    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        self[w] = i = len(self)
        self.new.append(w)
        return i


def fit_counts(train: DataFrame) -> Model:
    """train: (text, toxic). Every distinct gram is counted under its own key; the model is as large as they are many."""
    grams = train.select("text", "toxic").mapInArrow(lean(_count), "g long, c long, s long, n0 long, n1 long")
    grams = keep(grams.groupBy("g").agg(F.first("c").alias("c"), F.first("s").alias("s"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxicity_grams")
    n0, n1 = F.col("n0"), F.col("n1")
    histories = grams.groupBy("c").agg(F.sum(n0).cast("float"), F.sum(n1).cast("float"), F.count_if(n0 > 0).cast("float"), F.count_if(n1 > 0).cast("float"), F.count("*").cast("float"))
    return Model(_sorted(grams.select("g", n0.cast("float"), n1.cast("float"))), _sorted(histories), _sorted(grams.groupBy("s").agg(F.count("*").cast("float"))))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (intercept first) by Newton steps on standardised features."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / std])
    w, v = np.zeros(z.shape[1]), np.where(y == 1, TOXIC_WEIGHT, 1.0) / len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (v * (p - y)) + l2 * np.r_[0, w[1:]]
        h = (z * (v * p * (1 - p))[:, None]).T @ z + (l2 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, std


def _fold(doc_id):
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3).cast("int")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fold) of the rows whose labels may be learned from: crc32 of the id mod 3 is 0 (counts) or 2 (curve and counts)."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    one = keep(one.withColumn("fold", _fold(F.col("doc_id"))).filter("fold <> 1"), "toxicity_labels")
    one = F.broadcast(one) if fits_broadcast(one.count(), 32) else one  # else a shuffle join
    return docs.select("doc_id", "text").join(one, "doc_id").select("doc_id", "text", "toxic", "fold")


def set_aside(rows: DataFrame, n: dict[int, int]) -> Column:
    """Which of the labelled rows the curve is fitted on and no counts are taken from. n: rows of fold 2 by class."""
    h = F.xxhash64("doc_id", F.lit(7))
    share, out = min(0.5, CALIBRATION_ROWS / sum(n.values())), F.lit(False)
    for y, size in n.items():
        most = max(1, int(size * share))
        of = (F.col("fold") == 2) & (F.col("toxic") == y)
        # the lowest lie far below this bound, so few rows are sorted whatever the size
        bound = int(-(1 << 63) + (1 << 64) * min(1.0, (4 * most + 100) / size)) - 1
        cut = rows.filter(of & (h <= bound)).select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
        out = out | (of & (h <= cut)) if cut is not None else out
    return out


class Scorer:
    """A fitted model and its curve; apply() adds a score and what it predicts to any DataFrame with a column ``text``."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        spark = docs.sparkSession
        ship(spark)
        rows = keep(labelled(docs, labels), "toxicity_labelled")
        have = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
        self.ready = all(have.get((f, t)) for f in (0, 2) for t in (0, 1))
        if self.ready:
            aside = set_aside(rows, {y: have[2, y] for y in (0, 1)})
            self.model = model = spark.sparkContext.broadcast(fit_counts(rows.filter(~aside)))
            # rows that repeat a document count once here, so that the sample stays bounded
            sample = rows.filter(aside).dropDuplicates(["doc_id", "text"]).limit(2 * CALIBRATION_ROWS)

            def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    f = model.value.features(b.column(0).to_pylist())
                    yield pa.RecordBatch.from_arrays([*(pa.array(f[:, i]) for i in range(5)), b.column(1).cast(pa.float64())], names=list("abcdey"))

            got = sample.select("text", "toxic").mapInArrow(lean(feats), ", ".join(f"{c} double" for c in "abcdey")).toPandas().to_numpy()
            self.curve = logistic(got[:, :5], got[:, 5])
            release()  # the model has been sent, and the driver needs it no more

    def apply(self, docs: DataFrame, score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
        """docs (other columns untouched) plus its score (double, 0 to 1) and prediction (int) under these names."""
        if not self.ready:
            return docs.withColumns({score_name: F.lit(0.0), predicted_name: F.lit(0)})
        model, (w, mean, std) = self.model, self.curve

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                f = model.value.features(texts.to_pylist())
                z = np.hstack([np.ones((len(f), 1)), (f - mean) / std]) @ w
                yield pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6), pa.float64())
            release()

        score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}  # Spark reads real types
        out = docs.withColumn(score_name, F.arrow_udf(score, "double")(F.col("text").cast("string")))
        return out.withColumn(predicted_name, (F.col(score_name) >= THRESHOLD).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = Scorer(docs, labels).apply(docs.select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below the threshold, with their own columns."""
    score, predicted = free(docs, "score", "predicted")
    return Scorer(docs, labels).apply(docs, score, predicted).filter(F.col(predicted) == 0).drop(score, predicted)
