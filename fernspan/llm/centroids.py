"""Centroid clustering with annulus search.

Components become whole numbers, floor(``SCALE`` * x).  A centroid c can be as near to a vector x as some bound u only if their
norms differ by u at most: it lies in the annulus between the norms |x| - u and |x| + u.  Centroids are sorted by norm.  Each
vector finds its own norm among theirs by binary search, takes the centroid next to it for a first bound, and goes on outwards,
the nearer norm first, comparing exactly and narrowing the annulus with every better distance, until both sides are outside
(norms are rounded, so the annulus is wider by a billionth; those on its rim are compared, and ties go to the smaller number).

Scale: a round is one scan of the table; every task adds up its own vectors and hands on one row a cluster, so a shuffle has
k rows a task whatever the data, and the driver gets k x 64 sums.  Centroids (k rows) go along with the task.  Vectors
themselves are never shuffled or written, only their last assignment is, which the sums over clusters are made from.

Exactness: components of up to 2^22 are taken as doubles, in which all distances are whole numbers below 2^53; a batch with
larger ones is done in Python's whole numbers.  Sums are decimals of 38 digits, their quotients floors of whole numbers.

Defined results: a vector takes part if it has exactly ``DIM`` components, none null or not finite, none beyond 2^54 in size (whose
whole number would not fit a long); rows that repeat a vec_id take part each; a row without vec_id is assigned too but no
first centroid; first centroids with the same hash go by their components; fewer vectors than k make fewer centroids; a
distance or a sum beyond a long is held at the largest long; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernspan.session import keep, lean, ship

SCALE = 256
DIM = 64
K = 40
ROUNDS = 5
#: Components up to here are exact as doubles, and so are their squared distances.
EXACT = 1 << 22
LONG = (1 << 63) - 1
MARGIN = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 54)))
    return vectors.filter(F.size("embedding") == DIM).filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as doubles where they and their distances are exact, else as Python's numbers."""
    y = np.floor(SCALE * values)
    return y if not y.size or np.abs(y).max() <= EXACT else np.array([[int(c) for c in row] for row in y], object)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=1)


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1).astype(float))


class Annuli:
    """Centroids sorted by norm, and the search among them."""

    def __init__(self, centroids: list[list[int]]):
        big = max((abs(c) for row in centroids for c in row), default=0) > EXACT
        rows = np.array(centroids, object if big else float).reshape(len(centroids), -1)
        norms = _norms(rows)
        self.number = np.argsort(norms, kind="stable")
        self.rows, self.norms = rows[self.number], norms[self.number]

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector: its centroid's number, the squared distance, and how many centroids were compared."""
        n, k = len(v), len(self.norms)
        rows = self.rows.astype(object) if v.dtype == object else self.rows
        x = _norms(v)
        right = np.searchsorted(self.norms, x)
        left = right - 1
        padded = np.concatenate([[-np.inf], self.norms, [np.inf]])  # at place i + 1 the norm of i
        best, which = np.full(n, np.inf, rows.dtype), np.full(n, k)
        bound, compared = np.full(n, np.inf), np.zeros(n, np.int64)
        todo = np.arange(n)
        while len(todo):
            lo, hi = x[todo] - padded[left[todo] + 1], padded[right[todo] + 1] - x[todo]
            inside = np.minimum(lo, hi) <= bound[todo] + MARGIN * (1 + x[todo] + np.where(np.isfinite(bound[todo]), bound[todo], 0))
            inside &= np.isfinite(np.minimum(lo, hi))
            todo, below = todo[inside], (lo <= hi)[inside]
            if not len(todo):
                break
            at = np.where(below, left[todo], right[todo])
            left[todo[below]] -= 1
            right[todo[~below]] += 1
            d, number = _distance(v[todo], rows[at]), self.number[at]
            compared[todo] += 1
            better = (d < best[todo]) | (d == best[todo]) & (number < which[todo])
            won = todo[better]
            best[won], which[won] = d[better], number[better]
            bound[won] = np.sqrt(d[better].astype(float))
        return which, best, compared


def _rows(b: pa.RecordBatch) -> np.ndarray:
    a = b.column(1)
    return whole(a.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM))


def _sum_batches(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Annuli(centroids), len(centroids)
        sums, counts = [[0] * DIM for _ in range(k)], [0] * k
        for b in batches:
            if not b.num_rows:
                continue
            v = _rows(b)
            which, _, _ = search.nearest(v)
            for c in np.unique(which).tolist():
                mine = v[which == c]  # a batch's sums of doubles below 2^22 are whole numbers
                counts[c] += len(mine)
                sums[c] = [s + int(x) for s, x in zip(sums[c], mine.sum(axis=0), strict=True)]
        full = [c for c in range(k) if counts[c]]
        values = pa.array([[Decimal(counts[c]), *map(Decimal, sums[c])] for c in full], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), values], names=["cluster", "sums"])

    return run


def _assign_batches(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(centroids)
        for b in batches:
            if not b.num_rows:
                continue
            which, best, compared = search.nearest(_rows(b))
            distance = pa.array([min(int(d), LONG) for d in best], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(which.astype(np.int32)), distance, pa.array(compared.astype(np.int32))], names=["vec_id", "cluster", "distance", "compared"])

    return run


def first_centroids(kept: DataFrame, k: int = K) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids (a top-k, so each task hands on k rows at most)."""
    h = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = kept.filter("vec_id IS NOT NULL").orderBy(h, "v").limit(k).collect()
    return [[int(c) for c in whole(np.array([r["v"]]))[0]] for r in first]


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid that has vectors in the floors of their means."""
    parts = kept.mapInArrow(lean(_sum_batches(centroids)), "cluster int, sums array<decimal(38,0)>")
    cells = parts.select("cluster", F.posexplode("sums").alias("j", "s")).groupBy("cluster", "j").agg(F.sum("s").alias("s")).collect()
    by = {(r["cluster"], r["j"]): int(r["s"]) for r in cells}
    return [[by[c, j + 1] // by[c, 0] for j in range(DIM)] if (c, 0) in by else row for c, row in enumerate(centroids)]


def fit(kept: DataFrame, k: int = K, rounds: int = ROUNDS) -> list[list[int]]:
    ship(kept.sparkSession)
    centroids = first_centroids(kept, k)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids)
    return centroids


def assign(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance, compared): each vector's centroid, and how many of them were compared exactly."""
    ship(kept.sparkSession)
    schema = "vec_id long, cluster int, distance long, compared int"
    return kept.mapInArrow(lean(_assign_batches(centroids)), schema) if centroids else kept.sparkSession.createDataFrame([], schema)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark, kept = vectors.sparkSession, usable(vectors)
    centroids = fit(kept, k, rounds)
    own = keep(assign(kept, centroids).select("vec_id", "cluster", "distance"), "centroids")
    sums = {r["cluster"]: int(r["s"]) for r in own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), LONG)
    rows = [(c, min(sums[c], LONG), total, sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(sums)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return own.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most


def _oracle(k: int = K, rounds: int = ROUNDS) -> str:
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {DIM})",
        f"cells AS MATERIALIZED (SELECT rid, j, CAST(floor({SCALE} * CAST(embedding[j] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {DIM} + 1) AS t(j))",
        f"c0 AS MATERIALIZED (SELECT CAST(f.n - 1 AS INTEGER) AS cluster, cells.j, cells.x FROM (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id)) AS n FROM kept QUALIFY n <= {k}) f JOIN cells USING (rid))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT cells.rid, c{r}.cluster, CAST(sum((cells.x - c{r}.x) * (cells.x - c{r}.x)) AS BIGINT) AS distance FROM cells JOIN c{r} USING (j) GROUP BY ALL)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, cluster, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)")
        if r < rounds:
            mean = "CASE WHEN m.s >= 0 THEN m.s // m.n ELSE -((-m.s + m.n - 1) // m.n) END"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, o.j, coalesce({mean}, o.x) AS x FROM c{r} o LEFT JOIN (SELECT cluster, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN cells USING (rid) GROUP BY cluster, j) m USING (cluster, j))")
    facts = f"SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster"
    return (
        "WITH " + ", ".join(parts) + f" SELECT kept.vec_id, a{rounds}.cluster, a{rounds}.distance, CAST(sum(a{rounds}.distance) OVER (PARTITION BY a{rounds}.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a{rounds}.distance) OVER () AS BIGINT) AS inertia, facts.centroid_sha256 "
        f"FROM a{rounds} JOIN kept USING (rid) JOIN ({facts}) facts USING (cluster)"
    )


ORACLE_SQL = _oracle()
