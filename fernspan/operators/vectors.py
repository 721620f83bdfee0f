"""Dense vectors: cosine neighbours in blocks, pairs above a similarity, threshold clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernspan.operators.components import components
from fernspan.operators.stripes import Forest, met
from fernspan.session import Kept, ship

BLOCK = 2048
PAIRS = "a long, b long, cosine double"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    rows: list[list[float]] = []

    def out() -> pa.RecordBatch:
        m = np.array(rows, np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(n == 0, 1, n)
        return pa.RecordBatch.from_arrays([pa.array([f"{part}/{number}"]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["block", "ids", "m"])

    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            rows.append(v)
            if len(ids) == BLOCK:
                yield out()
                number, ids, rows = number + 1, [], []
    if ids:
        yield out()


def _cosines(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, z = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ids2"], "<i8")
    s = np.frombuffer(row["m"]).reshape(len(a), -1) @ np.frombuffer(row["m2"]).reshape(len(z), -1).T
    s[(a[:, None] == z[None, :]) | np.isnan(s)] = -2
    return a, z, s


def _rows(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "cosine"])


def _nearest(k: int):
    """The k largest of each row of a block over all the blocks that it meets here; ties go to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, None
        r, b, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.zeros(0)
        for batch in batches:
            for row in batch.to_pylist():
                if row["number"] != last:
                    if last is not None:
                        yield _rows(ids[r], b, s)
                    last, ids = row["number"], np.frombuffer(row["ids"], "<i8")
                    r, b, s, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(ids), -np.inf)
                _, z, new = _cosines(row)
                if np.isneginf(least).any() and new.shape[1] >= k:
                    least = np.maximum(least, np.partition(new, -k, axis=1)[:, -k])
                i, j = np.nonzero((new >= least[:, None]) & (new > -2))
                r, b, s = np.concatenate([r, i]), np.concatenate([b, z[j]]), np.concatenate([s, new[i, j]])
                order = np.lexsort((b, -s, r))
                r, b, s = r[order], b[order], s[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                r, b, s, place = (x[place < k] for x in (r, b, s, place))
                full = place == k - 1
                least[r[full]] = s[full]
        if last is not None:
            yield _rows(ids[r], b, s)

    return run


def _close(least: float, forest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Forest()
        for batch in batches:
            for row in batch.to_pylist():
                a, z, s = _cosines(row)
                hit = s >= least
                if row["number"] == row["other"]:
                    hit &= a[:, None] < z[None, :]
                i, j = np.nonzero(hit)
                if forest:
                    new = np.array(links.adds(a[i].tolist(), z[j].tolist()), bool)
                    i, j = i[new], j[new]
                yield _rows(np.minimum(a[i], z[j]), np.maximum(a[i], z[j]), s[i, j])

    return run


def _met(df: DataFrame, key: str, vector: str, compare: Callable, half: bool) -> DataFrame:
    """Blocks of vectors meet stripe by stripe (operators.stripes); each task holds two blocks and what it has found."""
    spark = df.sparkSession
    ship(spark)
    v = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    parts = max(1, v.count() // BLOCK)
    blocks = Kept(v.repartition(parts, key).sortWithinPartitions(key).mapInArrow(_blocks, "block string, ids binary, m binary"), "vector_blocks")
    if blocks.df.isEmpty():
        return spark.createDataFrame([], PAIRS)
    return met(blocks, compare, PAIRS, "vector_pairs", half)


def neighbours(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(a, b, cosine, rank): the k nearest other vectors of each vector."""
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return _met(df, key, vector, _nearest(k), False).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vote(nearest: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, predicted): the most frequent label among a row's neighbours, the smallest on ties."""
    l = labels.select(F.col(key).alias("b"), F.col(label).alias("l"))
    c = nearest.join(l, "b").groupBy("a", "l").agg(F.count("*").alias("n"))
    return c.groupBy("a").agg(F.min_by("l", F.struct(-F.col("n"), F.col("l"))).alias("predicted")).withColumnRenamed("a", key)


def close_pairs(df: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    return _met(df, key, vector, _close(least, False), True).filter("a < b")


def threshold_clusters(df: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """Single linkage at a similarity: components of the pairs that reach it, single vectors included. A task hands on only links that connect what its pairs do."""
    loops = df.select(F.col(key).alias("a"), F.col(key).alias("b"))
    e = _met(df, key, vector, _close(least, True), True).select("a", "b").unionByName(loops)
    return components(e, "a", "b").select(F.col("v").alias(key), F.col("component").alias("cluster"))
