"""Multi-class gradient boosting on histograms.

Columns are cut into bins at approximate quantiles (a sketch each, in one aggregate).  A round fits one tree a class to the softmax
gradients.  A level of all its trees is one pass: every task adds up gradients and hessians by (class, node, column, bin), tasks'
tables are summed by those keys, and the driver, which gets the sums (bounded by classes x nodes x columns x bins, whatever the
rows), chooses splits.  Gradients are added as whole numbers (multiples of 2^-26), so that sums, and with them the trees, do
not depend on how rows are dealt to tasks.

Rows carry their scores; trees grown since these were written last go along with the tasks, and every ``KEPT_EVERY`` rounds the
scores are written anew to the shared folder, which also cuts the lineage.

Defined results: a null or NaN goes left at every split; a column of one value is never split; equal gains go to the first column
and the lowest bin; a class that no row has keeps its score; an empty table cannot be fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernspan.session import Kept, ship

#: Gradients are whole multiples of 1 / UNIT.
UNIT = 1 << 26
KEPT_EVERY = 5


@dataclass
class Tree:
    """Nodes in heap order: column and bin of a split (rows with at most that bin go left), or a value where there is none."""

    column: list[int]
    cut: list[int]
    value: list[float]

    def at(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row comes to."""
        column, cut = np.array(self.column), np.array(self.cut)
        node = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            c = column[node]
            inner = c >= 0
            right = bins[np.arange(len(bins)), np.maximum(c, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node

    def values(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return np.array(self.value)[self.at(bins, depth)]


@dataclass
class Boosted:
    """A fitted model: column names, their cuts, classes, first scores, and a list of trees (one a class) for each round."""

    columns: list[str]
    cuts: list[list[float]]
    classes: list[str]
    start: list[float]
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def quantile_cuts(df: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """Per column at most bins - 1 cuts between its values: distinct approximate quantiles, the largest value left out."""
    usable = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*(F.percentile_approx(usable(c), at, 10_000).alias(f"q{i}") for i, c in enumerate(columns)), *(F.max(usable(c)).alias(f"m{i}") for i, c in enumerate(columns))).first()
    return [sorted({float(x) for x in row[f"q{i}"] or [] if x < row[f"m{i}"]}) for i in range(len(columns))]


def binned(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """0 for a missing value, else 1 + the number of cuts below it."""
    out = np.zeros(values.shape, np.int64)
    for j, c in enumerate(cuts):
        v = values[:, j]
        out[:, j] = np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(c), v, side="left"))
    return out


def gradients(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number gradients and hessians of the softmax loss by row and class."""
    p = softmax(scores)
    hot = np.zeros_like(p)
    hot[np.arange(len(y)), y] = 1
    return np.rint((p - hot) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64)


def _lists(a: pa.Array, width: int) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(depth: int, width: int, n_bins: int, since: list[list[Tree]], growing: list[Tree], rate: float):
    """A task's sums by (class, node of this level, column, bin)."""
    k = len(growing)
    low = (1 << depth) - 1  # nodes of this level begin here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, k * (1 << depth) * width * n_bins), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            y, bins, scores = b.column(0).to_numpy(zero_copy_only=False), _lists(b.column(1), width), _lists(b.column(2), k)
            scores = _advanced(scores, bins, since, rate)
            g, h = gradients(scores, y)
            for c, tree in enumerate(growing):
                node = tree.at(bins, depth) - low
                open_ = node >= 0
                at = (((c << depth) + node[open_, None]) * width + np.arange(width)) * n_bins + bins[open_]
                for s, x in enumerate((g, h)):
                    np.add.at(total[s], at.ravel(), np.repeat(x[open_, c], width))
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], names=["cell", "g", "h"])

    return run


def _advanced(scores: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]], rate: float) -> np.ndarray:
    for trees in rounds:
        scores = scores + rate * np.stack([t.values(bins, _depth_of(t)) for t in trees], axis=1)
    return scores


def _depth_of(t: Tree) -> int:
    return (len(t.column) + 1).bit_length() - 2


def best_split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int, int] | None:
    """(gain, column, bin) of the best split of a node, from its sums by column and bin; None if no split gains anything."""
    best = None
    scale = 1 / UNIT
    whole_g, whole_h = int(g[0].sum()), int(h[0].sum())
    base = (whole_g * scale) ** 2 / (whole_h * scale + ridge)
    for j in range(len(g)):
        left_g, left_h = np.cumsum(g[j])[:-1], np.cumsum(h[j])[:-1]
        a, b = left_h * scale, (whole_h - left_h) * scale
        gain = (left_g * scale) ** 2 / (a + ridge) + ((whole_g - left_g) * scale) ** 2 / (b + ridge) - base
        gain = np.where((a >= least) & (b >= least), gain, -np.inf)
        if len(gain) and (at := int(gain.argmax())) >= 0 and gain[at] > (best[0] if best else 1e-9) + (1e-12 if best else 0):
            best = (float(gain[at]), j, at)
    return best


def fit(df: DataFrame, columns: list[str], label: str, classes: list[str], rounds: int = 10, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: float = 1e-3) -> Boosted:
    """Trees of the given depth; ridge: added to the hessians of a leaf; least: hessian that a side of a split must have."""
    spark = df.sparkSession
    ship(spark)
    y = F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int") - 1
    rows = df.filter(F.col(label).isin(*classes))
    counts = {r["y"]: r["n"] for r in rows.groupBy(y.alias("y")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        raise ValueError("no rows to fit")
    total = sum(counts.values())
    start = [float(np.log(max(counts.get(i, 0), 1e-9) / total)) for i in range(len(classes))]
    model = Boosted(columns, quantile_cuts(rows, columns, bins), classes, start, depth)
    k, width, n_bins, cuts = len(classes), len(columns), bins + 1, model.cuts

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.stack([b.column(1 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(width)], axis=1) if b.num_rows else np.zeros((0, width))
            at = binned(values, cuts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(at), pa.list_(pa.int64())), pa.array([start] * b.num_rows, pa.list_(pa.float64()))], names=["y", "bins", "scores"])

    schema = "y int, bins array<long>, scores array<double>"
    held = Kept(rows.select(y.alias("y"), *(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(first, schema), "boosting")
    since: list[list[Tree]] = []
    for _ in range(rounds):
        size = (1 << (depth + 1)) - 1
        growing = [Tree([-1] * size, [0] * size, [0.0] * size) for _ in classes]
        for level in range(depth + 1):
            run = _sums(level, width, n_bins, since, growing, rate)
            got = held.df.mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
            g, h = np.zeros((k << level) * width * n_bins, np.int64), np.zeros((k << level) * width * n_bins, np.int64)
            cell = got.column("cell").to_numpy()
            g[cell], h[cell] = got.column("g").to_numpy(), got.column("h").to_numpy()
            g, h = g.reshape(k, 1 << level, width, n_bins), h.reshape(k, 1 << level, width, n_bins)
            for c, tree in enumerate(growing):
                for n in range(1 << level):
                    here = (1 << level) - 1 + n
                    if not h[c, n, 0].any() and not g[c, n, 0].any():
                        continue
                    tree.value[here] = -float(g[c, n, 0].sum()) / UNIT / (float(h[c, n, 0].sum()) / UNIT + ridge)
                    split = best_split(g[c, n], h[c, n], ridge, least) if level < depth else None
                    if split:
                        tree.column[here], tree.cut[here] = split[1], split[2]
        model.rounds.append(growing)
        since.append(growing)
        if len(since) == KEPT_EVERY:
            trees = since

            def forward(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    s = _advanced(_lists(b.column(2), k), _lists(b.column(1), width), trees, rate)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(s), pa.list_(pa.float64()))], names=["y", "bins", "scores"])

            new = Kept(held.df.mapInArrow(forward, schema), "boosting")
            held.drop()
            held, since = new, []
    held.drop()
    for trees in model.rounds:  # the rate goes into the leaves
        for t in trees:
            t.value = [rate * v for v in t.value]
    return model


def scored(model: Boosted, df: DataFrame, key: str) -> DataFrame:
    """(key, proba in the order of the model's classes, pred) of every row."""
    ship(df.sparkSession)
    width = len(model.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.stack([b.column(1 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(width)], axis=1) if b.num_rows else np.zeros((0, width))
            p = softmax(_advanced(np.tile(model.start, (len(values), 1)), binned(values, model.cuts), model.rounds, 1.0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(p), pa.list_(pa.float64())), pa.array([model.classes[i] for i in p.argmax(axis=1)], pa.string())], names=[key, "proba", "pred"])

    return df.select(key, *(F.col(c).cast("double").alias(f"__{c}") for c in model.columns)).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, proba array<double>, pred string")
