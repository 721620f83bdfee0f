"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous steps.

A document's tokens (ids, then ``END``) are cut into pieces of at most ``CAPACITY``; all but the first of a longer document are
full.  The pieces are range-sorted by length (longest first, then doc_id and piece) and numbered within their length: each
task numbers its own rows, and a small table of counts by (partition, length) gives the starts.

Since lengths and gaps are whole numbers up to the capacity, all pieces of one length, and all gaps of one size, are
interchangeable: the two sorted lists are runs, at most ``CAPACITY`` sizes each, whatever the number of rows.  Each step
takes the next shorter length and sweeps the gaps upwards from their successor (the smallest gap that holds it); pieces
claim gaps by rank, the lower rank the earlier sequence; where several pieces of that length fit one gap they
share it; the gaps are updated; the step repeats until the length's pieces are placed, opening sequences where no gap is
left.  That is best-fit decreasing exactly.  A step yields run-length rules (length, first rank, rank after the last, first
sequence, pieces a sequence, offset), and the rows find theirs by their rank, in parallel.

What meets on the driver: counts by length and the rules, both bounded by the capacity (not the rows).

Defined results: null text counts as empty (one piece: END alone); rows that repeat a doc_id are packed one by one, null
doc_ids too; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernspan.llm.vocabulary import default_path, unusual, vocabulary
from fernspan.session import fits_broadcast, keep, lean, ship

CAPACITY = 1024
END = 2
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, odd: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, end = vocabulary(path, odd), END.to_bytes(4, "little")
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(v.ids(text or "") + end)
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    to = min(n, first if k == 0 else at + capacity)
                    rows.append((doc_id, k, at, to - at, zlib.crc32(ids[at * 4 : to * 4])))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the rank among its rows of the same length; rows come sorted by length."""
    pid, length, rank = TaskContext.get().partitionId(), -1, 0
    for b in batches:
        n = b.column(3).to_numpy()
        if not len(n):
            continue
        begin = np.flatnonzero(np.diff(n, prepend=-1))
        at = np.arange(len(n)) - np.repeat(begin, np.diff(np.append(begin, len(n))))
        if n[0] == length:
            at[: begin[1] if len(begin) > 1 else len(n)] += rank
        length, rank = int(n[-1]), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), pid, np.int64)), pa.array(at.astype(np.int64))], names=[*b.schema.names, "pid", "rank"])


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rules (length, first rank, rank after the last, first sequence, pieces a sequence, offset) of best-fit decreasing, and the number of sequences."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    rules, opened = [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[length]
        while left:
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is None:
                k = capacity // length
                gaps[capacity] = [(opened, -(-left // k))]
                opened += -(-left // k)
                continue
            first, n = gaps[fit].pop(0)
            if not gaps[fit]:
                del gaps[fit]
            k = fit // length
            whole = min(n, left // k)
            if whole:
                rules.append((length, rank, rank + whole * k, first, k, capacity - fit))
                if fit > k * length:
                    gaps.setdefault(fit - k * length, []).append((first, whole))
                rank, left = rank + whole * k, left - whole * k
            if whole < n:
                if left and left < k:  # the last pieces of this length share one sequence
                    rules.append((length, rank, rank + left, first + whole, left, capacity - fit))
                    if fit > left * length:
                        gaps.setdefault(fit - left * length, []).append((first + whole, 1))
                    rank, left, whole = rank + left, 0, whole + 1
                if whole < n:
                    gaps.setdefault(fit, []).insert(0, (first + whole, n - whole))
    return np.array(rules, np.int64).reshape(-1, 6), opened


def _place(rules):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, key = rules.value
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, (CAPACITY_BITS - n) * RANKS + rank, "right") - 1
            _, r0, _, s0, k, offset = table[at].T
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(s0 + (rank - r0) // k), pa.array(offset + (rank - r0) % k * n)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return place


#: A rule is found by (length, longest first; rank) in one number.
RANKS, CAPACITY_BITS = 1 << 42, 1 << 20


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    if not 0 < capacity < CAPACITY_BITS:
        raise ValueError("capacity out of range")
    path = path or default_path()
    raw = keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_pieces(path, unusual(path), capacity)), _SCHEMA), "pack_pieces")
    order = [F.col("length").desc(), F.col("doc_id").asc(), F.col("piece").asc(), F.col("ids_crc32").asc()]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = raw.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = keep(ranged.mapInArrow(lean(_number), f"{_SCHEMA}, pid long, rank long"), "pack_ranks")
    tally = keep(numbered.groupBy("length", "pid").agg(F.count("*").alias("n")), "pack_tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table, _ = best_fit(counts, capacity)
    rules = spark.sparkContext.broadcast((table, (CAPACITY_BITS - table[:, 0]) * RANKS + table[:, 1]))
    # starts of each partition's ranks: one row for each partition that has a length, so this window is small
    w = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(tally.select(F.col("length").alias("l"), F.col("pid").alias("p"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")), "pack_starts")
    starts = F.broadcast(starts) if fits_broadcast(starts.count(), 40) else starts
    ranked = numbered.join(starts, (F.col("length") == F.col("l")) & (F.col("pid") == F.col("p"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(lean(_place(rules)), f"{_SCHEMA}, sequence_id long, offset long")
