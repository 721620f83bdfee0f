"""Exact top-k search against brute force, at all magnitudes, with repeats, empties and real pruning."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernspan.llm import topk
from tests.llm.test_llm import saved

LONG = (1 << 63) - 1


def whole(x):
    return int(x) * 64 if abs(x) >= 1 << 60 else math.floor(64 * x)


def brute_top(rows, k=20, every=20):
    v = [(i, [whole(c) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for q in sorted({i for i, _ in v if i % every == 0}):
        s = []
        for i, x in v:
            if i == q:
                s += [(-min(max(sum(a * b for a, b in zip(x, y, strict=False)), -LONG - 1), LONG), c) for c, y in v if c != q]
        out += [(q, n + 1, c, -x) for n, (x, c) in enumerate(sorted(s)[:k])]
    return out


def found(df):
    return sorted(tuple(x) for x in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "GROUP", 64)
    monkeypatch.setattr(topk, "TILE", 4)


def test_equals_brute_force(spark, small):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(12)]) for i in range(300)] + [(400 + i, [0.5] * 12) for i in range(30)]
    rows += [(1000, None), (1001, [float("nan")] * 12), (1002, [None, 1.0]), (1003, []), (1004, [float("inf")] * 12), (None, [1.0] * 12), (1005, [3.0, -2.0])]
    rows += [(40, [0.25] * 12), (40, [0.25] * 12), (41, [2.0] * 12), (41, [2.0] * 12), (60, []), (-20, [1.0] * 12)]  # repeated rows
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"b": F.lit(1), "v.x": F.lit(2), "score": F.lit("s")})
    assert found(topk.search(saved(d, spark))) == brute_top(rows)
    assert topk.search(d.filter("vec_id < -20")).count() == 0
    assert topk.search(d.filter("vec_id = 20")).count() == 0


@pytest.mark.parametrize("size", [4e6, 1e12, 1e30, 1e300, 1.7e308])
def test_large_components(spark, small, size):
    rows = [(20, [1.0, 1.0]), (21, [size, 0.0]), (22, [size * 0.75, 0.0]), (23, [-size, 3.0]), (24, [0.1, 0.2]), (40, [size, size])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(topk.search(d)) == brute_top(rows)


def test_empty_vectors_only(spark):
    rows = [(i, []) for i in [*range(50), 7, 7, 0]]
    assert found(topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == brute_top(rows)


def test_blocks_below_the_kth_score_stay_where_they_are(spark, small, monkeypatch):
    """With vectors of like direction in one block most blocks are never sent to a query."""
    r = np.random.default_rng(5)
    centres = r.normal(0, 1, (12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + r.normal(0, 0.02, 16)]) for i in range(960)]
    d = saved(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark)
    index = topk.Index(d)
    queries = index.v.filter("vec_id % 20 = 0").select(F.lit(0).cast("long").alias("t"), F.col("vec_id").alias("query_id"), "v")
    for lo in (0, 20, 40):  # a query at a time
        one = queries.filter(F.col("query_id") == lo)
        needed = index.needed(one, 20, 1)[1].count()
        assert needed < 0.4 * index.blocks.count()
    assert found(topk.search(d)) == brute_top(rows)
