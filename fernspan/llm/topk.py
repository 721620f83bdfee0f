"""Exact top-k inner products by block-at-a-time pruning.

Components become whole numbers, floor(``SCALE`` * x).  Vectors are numbered anew, those of like direction next to each other (by the
signs of ``SIGNS`` fixed projections, then vec_id), and cut into document-range blocks of ``BLOCK`` vectors; a block is a
forward index (ids and a matrix) with the largest and smallest value of every term.  For a query the summed term maxima (its
positive terms times the largest, its negative ones times the smallest values) bound every score in a block.

Bounds come before data: queries first meet only the blocks' maxima.  Each query's few best blocks by bound are scored and
give it a first k-th score; then only blocks whose bound reaches some query's k-th score travel to those queries.  There
blocks are taken in the order of their bounds and scored through their forward index, and a query is done once the next
bound falls below its k-th score (a bound that equals it may still win the tie by a smaller vec_id).

Scale: the stated queries meet all rows in blocks.  Tiles of about ``TILE`` queries and groups of about ``GROUP`` / ``BLOCK`` blocks meet under
the pair of their numbers, so each task holds one group and one tile (a few MB) and yields k rows a query; the groups'
results meet in a window of k rows a group and query.  Nothing is collected but counts.  Where vectors have no
directions in common (random ones in many dimensions) no exact bound prunes, and every block is scored.

Defined results: a vector that is null or has a null or non-finite component takes no part, nor does a row without vec_id; an
empty vector scores 0 with all; shorter vectors lack the last terms; rows that repeat a vec_id are candidates each, none
of them to a query of that id, and as queries share one list of k; a score beyond a long is held at its bounds; other
columns are not looked at; no queries or no candidates: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernspan.session import fits_broadcast, keep, ship

SCALE = 64
K = 20
BLOCK = 128
GROUP = 8192
TILE = 1024
SIGNS = 16
#: Blocks beyond those that hold k vectors, from which a query gets its first k-th score.
FIRST = 1
EVERY = 20
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of doubles as rows, shorter ones with zeros at the end."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(a.offsets.to_numpy()) if len(a) else np.zeros(0, np.int64)
    out = np.zeros((len(a), dim))
    out[np.arange(dim) < n[:, None]] = a.flatten().to_numpy(zero_copy_only=False)
    return out


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): as doubles, which hold it exactly below 2^53, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        w = np.floor(x * SCALE)
    if np.abs(w).max(initial=0) < _EXACT:
        return w
    exact = [int(v) * SCALE if abs(v) >= _EXACT else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def _block_up(dim: int, block: int):
    """Rows in their new order to blocks of up to so many vectors, with their numbers and the maxima and minima of their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def out(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            w = whole(x)
            hi, lo = (np.array([_double(v) for v in f(w, 0)]) for f in (np.max, np.min))
            cols = [(part << 32) + number, i.astype("<i8").tobytes(), x.astype("<f8").tobytes(), hi.astype("<f8").tobytes(), lo.astype("<f8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(cols)], names=["b", "ids", "m", "hi", "lo"])

        for b in batches:
            if not b.num_rows:
                continue
            ids.append(b.column(0).to_numpy())
            held.append(matrix(b.column(1), dim))
            size += b.num_rows
            while size >= block:
                i, x = np.concatenate(ids), np.concatenate(held)
                yield out(i[:block], x[:block])
                number, ids, held, size = number + 1, [i[block:]], [x[block:]], size - block
        if size:
            yield out(np.concatenate(ids), np.concatenate(held))

    return run


def _directions(dim: int):
    """Adds the code by which vectors are numbered anew."""
    axes = np.random.default_rng(7).normal(size=(dim, SIGNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            x = x / np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]
            code = ((x @ axes) > 0) @ (1 << np.arange(SIGNS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int64))], names=["vec_id", "v", "code"])

    return run


def bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Summed term maxima, queries by blocks; never below any score. All are whole numbers, as doubles."""
    with np.errstate(all="ignore"):
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        out = up @ hi.T + down @ lo.T
        size = np.abs(q) @ np.maximum(np.abs(hi), np.abs(lo)).T
        return np.where(np.isfinite(size), np.where(size < _EXACT, out, out + 1e-9 * size), np.inf)


def _doubles(w: np.ndarray) -> np.ndarray:
    if w.dtype != object:
        return w
    return np.array([_double(v) for v in w.ravel()]).reshape(w.shape)


def _double(v: float) -> float:
    return float(v) if abs(v) < 1 << 1000 else float("inf") if v > 0 else float("-inf")


def _bounds_of(queries: pa.Table, blocks: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    hi, lo = (np.frombuffer(b"".join(blocks.column(c).to_pylist()), "<f8").reshape(-1, dim) for c in ("hi", "lo"))
    return bounds(_doubles(whole(matrix(queries.column("v"), dim))), hi, lo), blocks.column("b").to_numpy()


def _best_blocks(dim: int, n_first: int):
    """For each query of a tile its first blocks of a group by bound."""

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(queries) or not len(blocks):
            return pa.table({"t": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "bound": pa.array([], pa.float64())})
        at, b = _bounds_of(queries, blocks, dim)
        first = np.argsort(-at, 1, kind="stable")[:, :n_first]
        n, rows = first.shape[1], len(at)
        same = lambda c: pa.array(np.full(rows * n, queries.column(c)[0].as_py(), np.int64))
        return pa.table({"t": same("t"), "g": same("g"), "b": b[first.ravel()], "query_id": np.repeat(queries.column("query_id").to_numpy(), n), "bound": np.take_along_axis(at, first, 1).ravel()})

    return run


def _needed_blocks(dim: int):
    """Which blocks of a group have a bound that reaches some query's k-th score."""

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out = np.zeros(0, np.int64)
        t = g = 0
        if len(queries) and len(blocks):
            t, g = (queries.column(c)[0].as_py() for c in ("t", "g"))
            at, b = _bounds_of(queries, blocks, dim)
            kth = np.array([float("-inf") if x is None else float(x) for x in queries.column("kth").to_pylist()])
            out = b[(at >= kth[:, None]).any(0)]
        return pa.table({"t": pa.array(np.full(len(out), t, np.int64)), "g": pa.array(np.full(len(out), g, np.int64)), "b": out})

    return run


def best(query: np.ndarray, own: int, order: np.ndarray, at: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, kth: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """One query against blocks in the order of their bounds, from a k-th score known before: (ids, scores, blocks scored)."""
    ids, scores, done = np.zeros(0, np.int64), np.zeros(0, query.dtype), 0
    for b in order:
        if kth is not None and at[b] < kth:
            break
        done += 1
        block_ids, m = blocks[b]
        s = m @ query
        ok = block_ids != own
        if kth is not None:
            ok &= s >= kth
        if ok.any():
            ids, scores = np.concatenate([ids, block_ids[ok]]), np.concatenate([scores, s[ok]])
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]
            if len(ids) == k and (kth is None or scores[-1] > kth):
                kth = scores[-1]
    return ids, scores, done


def _search(k: int, dim: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(rows):
            at, _ = _bounds_of(queries, rows, dim)
            blocks = [(np.frombuffer(i, "<i8"), whole(np.frombuffer(m, "<f8").reshape(-1, dim))) for i, m in zip(rows.column("ids").to_pylist(), rows.column("m").to_pylist(), strict=True)]
            q = whole(matrix(queries.column("v"), dim))
            largest = lambda w: float(np.abs(w).max(initial=0)) if w.dtype != object else float("inf")
            if not largest(q) * max(largest(m) for _, m in blocks) * dim < _EXACT:  # in whole numbers of any size
                exact = lambda w: np.array([int(v) for v in w.ravel()], object).reshape(w.shape)
                q, blocks = exact(q), [(i, exact(m)) for i, m in blocks]
            orders = np.argsort(-at, 1, kind="stable")
            known = queries.column("kth").to_pylist()
            for r, own in enumerate(queries.column("query_id").to_pylist()):
                kth = None if known[r] is None or abs(known[r]) >= _LONG else known[r]
                found, scores, _ = best(q[r], own, orders[r], at[r], blocks, k, kth)
                if scores.dtype == object:
                    scores = np.array([min(max(v, -_LONG - 1), _LONG) for v in scores], np.int64)
                out.append((np.full(len(found), own, np.int64), found, scores.astype(np.int64)))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 3)]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


_RESULT = "query_id long, vec_id long, score long"


class Index:
    """Blocks of all usable vectors, written to the shared folder."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        ship(spark)
        self.v = usable(vectors)
        size = self.v.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("rows")).first()
        self.rows, self.dim = size["rows"], size["dim"] or 0
        if self.dim:
            coded = self.v.mapInArrow(_directions(self.dim), "vec_id long, v array<double>, code long")
            self.groups = max(1, -(-self.rows // GROUP))
            # ids break ties of the code, so that one direction shared by many vectors still spreads over partitions
            ordered = coded.repartitionByRange(self.groups, "code", "vec_id").sortWithinPartitions("code", "vec_id").select("vec_id", "v")
            made = ordered.mapInArrow(_block_up(self.dim, BLOCK), "b long, ids binary, m binary, hi binary, lo binary")
            self.blocks = keep(made.withColumn("g", F.pmod(F.xxhash64("b"), F.lit(self.groups))), "topk_blocks")

    def needed(self, queries: DataFrame, k: int, tiles: int) -> tuple[DataFrame, DataFrame]:
        """Queries with their first k-th scores, and the blocks (t, g, b) whose bounds reach one of them."""
        dim, spread = self.dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("t")
        n_first = FIRST - (-(k + 1) // BLOCK)
        ends = self.blocks.select("g", "b", "hi", "lo", spread)
        at = queries.select("t", "query_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.groups - 1).cast("long"))).alias("g"))
        first = at.groupBy("t", "g").cogroup(ends.groupBy("t", "g")).applyInArrow(_best_blocks(dim, n_first), "t long, g long, b long, query_id long, bound double")
        top = Window.partitionBy("t", "query_id").orderBy(F.col("bound").desc(), "b")
        first = keep(first.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= n_first).select("t", "g", "b").distinct(), "topk_first")
        scored = self._scored(queries.withColumn("kth", F.lit(None).cast("long")), first, k)
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
        kth = keep(scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("query_id", F.col("score").alias("kth")), "topk_kth")
        known = keep(queries.join(kth, "query_id", "left").select("t", "query_id", "v", "kth"), "topk_queries")
        at = known.select("t", "query_id", "v", "kth", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.groups - 1).cast("long"))).alias("g"))
        return known, keep(at.groupBy("t", "g").cogroup(ends.groupBy("t", "g")).applyInArrow(_needed_blocks(dim), "t long, g long, b long"), "topk_needed")

    def _scored(self, queries: DataFrame, needed: DataFrame, k: int) -> DataFrame:
        small = F.broadcast(needed) if fits_broadcast(needed.count(), 64) else needed
        blocks = self.blocks.drop("g").join(small, "b")
        groups = needed.select(F.col("t").alias("t"), F.col("g").alias("g")).distinct()  # columns of its own beside those of blocks
        at = queries.join(F.broadcast(groups) if fits_broadcast(needed.count(), 64) else groups, "t")
        return at.groupBy("t", "g").cogroup(blocks.groupBy("t", "g")).applyInArrow(_search(k, self.dim), _RESULT)

    def search(self, k: int, every: int) -> DataFrame:
        wanted = self.v.filter(F.col("vec_id") % every == 0)
        n = wanted.count()
        tiles = max(1, -(-n // TILE))
        queries = keep(wanted.select(F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).alias("t"), F.col("vec_id").alias("query_id"), "v"), "topk_wanted")
        known, needed = self.needed(queries, k, tiles)
        return self._scored(known, needed, k)


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """For each vector whose vec_id is divisible by every: query_id, rank, vec_id, score of the k best others."""
    index = Index(vectors)
    if index.dim:
        found = index.search(k, every)
    elif index.rows:  # empty vectors only: all score 0
        found = _all_empty(index.v, k, every)
    else:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _all_empty(v: DataFrame, k: int, every: int) -> DataFrame:
    """All scores are 0, so the smallest ids win: k + 1 rows of other ids, and those of each query's own id left out."""
    queries = v.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"))
    ids = v.groupBy("vec_id").agg(F.count("*").alias("n")).orderBy("vec_id").limit(k + 1)
    ids = ids.select("vec_id", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))).alias("i")).select("vec_id").agg(F.collect_list("vec_id").alias("all"))
    both = queries.select("query_id", F.lit(1).alias("one")).join(F.broadcast(ids.withColumn("one", F.lit(1))), "one")
    return both.select("query_id", F.explode("all").alias("vec_id")).filter("vec_id <> query_id").withColumn("score", F.lit(0).cast("long"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x : cast(floor(64 * cast(x AS double)) AS bigint)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z : z[1] * z[2])), 0) AS bigint) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
