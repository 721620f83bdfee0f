"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

Documents are sets of word ``SHINGLE``-grams.  Documents with the same set collapse to one node first.  Grams are ordered by how
often they occur in the whole corpus (counted in ``CELLS`` hashed cells, so the table that is broadcast is 4 MB whatever
the input; a collision changes the order, never the result), ties by hash.  Two sets with a Jaccard index of 0.8 share
a gram among the first n - ceil(0.8 n) + 1 of each, so only these are dealt out by gram, packed 24 bytes each.  In the bucket
of a gram the length and positional filters apply, before a pair's sets are fetched the suffix filter (gram counts in
``PARTS`` hash classes bound the overlap), and sets are compared exactly.

Groups are never expanded into all pairs.  A bucket of up to ``HUBS`` + 1 nodes yields its pairs, a larger one only pairs with its
``HUBS`` nodes of lowest number.  The links found give components.  Later rounds look at buckets that still hold several
components and take pairs across them only, since a link inside a component can't change the result: first ``CAPS`` partners for
each node outside the bucket's largest component, which nearly always joins it, in the last round all that are left.  Every
pair across components that prefix filtering admits is thus verified, and no pair twice.

Sets are sent for few pairs: where pairs are more than twice the nodes, each node is first compared with one partner, and then
the pairs whose ends are still in different components, with one each once more and at last with all that are left.

Scale: what is shuffled is packed posts (24 bytes a prefix gram), pairs, and the sets of candidates.  A bucket whose gram may have
more than ``SALT_ROWS`` posts is dealt to several tasks, whose nodes meet in the later rounds; there a bucket is cut into
slices of ``SLICE`` rows, and each pair of slices (nodes outside the largest component by all nodes; in the capped rounds each
of them by ``SOME`` slices) is a group of its own, so no bucket lands in one task.  Counts of cells are summed in two steps.

Defined results: no words or no text: an empty set, linked with nothing; fewer than five words: one gram, the whole sequence;
null doc_id: its row has a null component and joins nothing; rows that repeat a doc_id each get their own set's component;
very long texts are read whole (a set takes 8 bytes a distinct gram, and must fit a task); other columns, whatever their
names, are not looked at; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspan.operators.components import components
from fernspan.session import Kept, fits_broadcast, keep, lean, release, ship, small_batches, tidy

SHINGLE = 5
CELL_BITS = 22
CELLS = 1 << CELL_BITS
PART_BITS = 6
PARTS = 1 << PART_BITS
HUBS = 6
#: Partners a node takes in the rounds before the last, which has no cap.
CAPS = (12, 96)
#: Rounds in which each node's set is compared with one partner's, before all pairs that are left across components.
THIN = 2
#: Posts that a gram may have before its bucket is dealt to several tasks, and rows of a slice of a bucket in the later rounds.
SALT_ROWS = 1 << 20
SLICE = 128
#: Slices of a bucket that a node meets in the capped rounds.
SOME = 4
#: Bytes of packed grams that one range should hold; the number of ranges follows from the input.
RANGE_BYTES = 4 << 20
FLUSH = 300_000
#: Rows that reach a Python worker at a time: whole texts, or packed blocks of some 50 KB.
BATCH_ROWS = 256
#: Words, and sets, that a worker remembers before it starts anew.
WORDS = 200_000
POST = np.dtype([("t", "<u8"), ("f", "<u8"), ("n", "<u4"), ("p", "<u4")])
#: Marks the posts of a salted bucket, in p.
SALTED = 1 << 31
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_words = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _Q
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's grams. Only A-Z is lowered, and only ASCII white space separates."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(a))
    h = np.full(len(a) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _P + a[i : len(a) - k + 1 + i]
        h ^= h >> np.uint64(29)
    return np.unique(_mix(h))


def set_id(s: np.ndarray) -> int:
    """64 bits of a whole set (as a signed long): the number of its node."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """ceil(0.8 n)"""
    return (4 * n + 4) // 5


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document (kind 0), and what this task counts in the cells (kind 1), sparse, by range of 65,536 cells."""
    counts, waiting, n_waiting = np.zeros(CELLS, np.int64), [], 0

    def add() -> None:
        nonlocal n_waiting
        if waiting:
            np.add(counts, np.bincount(np.concatenate(waiting), minlength=CELLS), out=counts)
            waiting.clear()
            n_waiting = 0

    names = ["kind", "doc_id", "n", "f", "sig", "r", "cells"]
    for b in batches:
        n, f, sig = [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            f.append(set_id(s))
            sig.append(np.bincount((s >> np.uint64(20)).astype(np.int64) & (PARTS - 1), minlength=PARTS).astype("<u4").tobytes())
            waiting.append((s >> np.uint64(64 - CELL_BITS)).astype(np.int64))
            if (n_waiting := n_waiting + len(s)) > 2_000_000:
                add()
        k = len(n)
        yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), b.column(0), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(sig, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
    add()
    _words.clear()
    rows = []
    for r in range(CELLS >> 16):
        part = counts[r << 16 : (r + 1) << 16]
        at = np.flatnonzero(part)
        if len(at):
            rows.append((r, at.astype("<u2").tobytes() + part[at].astype("<u8").tobytes()))
    if rows:
        k = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=names)


def _sum_cells(final: bool):
    """Sums of the counts of each range of cells: as they came, or (final) as the rough logarithm that the order needs, one byte a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = len(x) // 10
                s = sums.setdefault(r, np.zeros(1 << 16, np.int64))
                s[np.frombuffer(x, "<u2", k)] += np.frombuffer(x, "<u8", k, 2 * k).astype(np.int64)
        rows = []
        for r, s in sums.items():
            at = np.flatnonzero(s)
            rows.append((r, _classes(s).tobytes() if final else at.astype("<u2").tobytes() + s[at].astype("<u8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], names=["r", "cells"])

    return run


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(6 * np.log2(counts + 1.0))).astype(np.uint8)


def salts(classes: np.ndarray, salt_rows: int) -> np.ndarray:
    """Into how many parts the buckets of cells of these classes are dealt: a gram has no more posts than its cell has counts."""
    return np.ceil(np.exp2((classes.astype(np.float64) + 0.5) / 6) / salt_rows).astype(np.uint64)


def prefix(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set's rarest grams, in the global order, as many as any set that it links with must share one of."""
    p = len(s) - int(needed(len(s))) + 1
    rank = (classes[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    first = np.argpartition(rank, p - 1)[:p] if p < len(s) else np.arange(len(s))
    return s[first[np.argsort(rank[first], kind="stable")]]


def _posting(classes, ranges: int, salt_rows: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            a = np.concatenate(held)
            parts = salts(classes.value[(a["t"] >> np.uint64(64 - CELL_BITS)).astype(np.int64)], salt_rows)
            a["p"][parts > 1] |= np.uint32(SALTED)
            r = (((a["t"] >> np.uint64(3)) + _mix(a["f"]) % parts * _P) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(r, kind="stable")
            a, r = a[order], r[order]
            cuts = np.flatnonzero(np.diff(r, prepend=-1))
            ends = np.append(cuts[1:], len(r))
            return pa.RecordBatch.from_arrays([pa.array(r[cuts], pa.int64()), pa.array([a[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary())], names=["r", "posts"])

        for b in batches:
            for text in b.column(0).to_pylist():
                s = shingle_set(text)
                if not len(s):
                    continue
                key = (set_id(s), len(s))
                if key in seen:
                    continue
                if len(seen) > WORDS:
                    seen.clear()
                seen.add(key)
                t = prefix(s, classes.value)
                x = np.empty(len(t), POST)
                x["t"], x["f"], x["n"], x["p"] = t, key[0] & 0xFFFFFFFFFFFFFFFF, len(s), np.arange(len(t))
                held.append(x)
                if (size := size + len(t)) > FLUSH:
                    yield flush()
                    held, size = [], 0
        _words.clear()
        if held:
            yield flush()

    return deal


def admitted(na, pa_, nb, pb) -> np.ndarray:
    """Length and positional filter: could these two, meeting first at this gram, still reach 9 * overlap >= 4 * (na + nb)?"""
    na, nb, pa_, pb = (np.asarray(x, np.int64) for x in (na, nb, pa_, pb))
    return (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (9 * np.minimum(na - pa_, nb - pb) >= 4 * (na + nb))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (kind 0) of each range's buckets, and the rows of the buckets too large to be done with (kind 1)."""
    by_range: dict[int, list[bytes]] = {}
    for b in batches:
        for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by_range.setdefault(r, []).append(x)
    release()
    for r in list(by_range):
        a = np.frombuffer(b"".join(by_range.pop(r)), POST)
        a = a[np.lexsort((a["n"], a["f"], a["t"]))]
        new_t = np.diff(a["t"], prepend=~a["t"][:1]) != 0
        distinct = new_t | (np.diff(a["f"], prepend=~a["f"][:1]) != 0) | (np.diff(a["n"].astype(np.int64), prepend=-1) != 0)
        a = a[distinct]
        salted = (a["p"] & np.uint32(SALTED)) > 0
        a["p"] &= np.uint32(SALTED - 1)
        begin = np.flatnonzero(np.diff(a["t"], prepend=~a["t"][:1]) != 0)
        m = np.diff(np.append(begin, len(a)))
        pairs = []

        def take(i: np.ndarray, j: np.ndarray, a=a, pairs=pairs) -> None:
            ok = admitted(a["n"][i], a["p"][i], a["n"][j], a["p"][j])
            i, j = i[ok], j[ok]
            pairs.append(np.stack([a["f"][i], a["n"][i].astype(np.uint64), a["f"][j], a["n"][j].astype(np.uint64)], 1))

        for size in range(2, HUBS + 2):
            at = begin[m == size]
            for x in range(size):
                for y in range(x + 1, size):
                    take(at + x, at + y)
        large = np.flatnonzero(m > HUBS + 1)
        for k in large:
            rows = np.arange(begin[k], begin[k] + m[k])
            rows = rows[np.argsort(np.ascontiguousarray(a["f"][rows]).view(np.int64), kind="stable")]
            for h in range(HUBS):
                take(np.full(len(rows) - h - 1, rows[h]), rows[h + 1 :])
        if pairs and sum(map(len, pairs)):
            x = np.unique(np.concatenate(pairs), axis=0)
            swap = (x[:, 0] > x[:, 2]) | ((x[:, 0] == x[:, 2]) & (x[:, 1] > x[:, 3]))
            x[swap] = x[swap][:, [2, 3, 0, 1]]
            x = np.unique(x, axis=0).view(np.int64)
            yield _bucket_rows(0, x[:, 0], x[:, 1], x[:, 2], x[:, 3], np.zeros(len(x), np.int64))
        open_ = np.flatnonzero((m > HUBS + 1) | salted[begin])
        if len(open_):
            rest = a[np.concatenate([np.arange(begin[k], begin[k] + m[k]) for k in open_])]
            yield _bucket_rows(1, rest["f"].view(np.int64) if rest["f"].flags.c_contiguous else rest["f"].astype(np.int64), rest["n"].astype(np.int64), np.ascontiguousarray(rest["t"]).view(np.int64), rest["p"].astype(np.int64), np.zeros(len(rest), np.int64))


def _bucket_rows(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *(pa.array(np.ascontiguousarray(c), pa.int64()) for c in cols[:4])], names=["kind", "f", "n", "g", "m"])


def _across(capped: bool):
    """Admitted pairs across components within each group: nodes outside the bucket's largest component (side 1) by a slice of all (side 0).

    A group is one slice of either side, all of whose rows are in this task.  If capped, each node of side 1 takes ``most``
    partners of the slice at most, by lowest hash of the pair; otherwise all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held) if (held := list(batches)) else None
        if table is None or not len(table):
            return
        g, side, x, n, p, c, most = (table.column(i).to_numpy() for i in range(7))
        order = np.lexsort((n, side, g))
        g, side, x, n, p, c, most = g[order], side[order], x[order], n[order], p[order], c[order], most[order]
        begin = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
        ends = np.append(begin[1:], len(g))
        out: list[np.ndarray] = []
        size = 0
        for i, j in zip(begin, ends, strict=True):
            mid = i + int(np.searchsorted(side[i:j], 1))
            for k in range(mid, j):
                # rows are in order of size: partners lie where the length filter lets them
                lo = int(np.searchsorted(n[i:mid], needed(int(n[k])), "left")) + i
                hi = int(np.searchsorted(n[i:mid], n[k] * 5 // 4, "right")) + i
                ys = np.arange(lo, hi)
                ys = ys[(c[ys] != c[k]) & admitted(n[k], p[k], n[ys], p[ys])]
                if capped and len(ys) > most[k]:
                    pair = _mix((np.minimum(x[k], x[ys]).astype(np.uint64) * _P) ^ np.maximum(x[k], x[ys]).astype(np.uint64))
                    ys = ys[np.argpartition(pair, most[k])[: most[k]]]
                if len(ys):
                    out.append(np.stack([np.minimum(x[k], x[ys]), np.maximum(x[k], x[ys])], 1))
                    if (size := size + len(ys)) > 200_000:
                        out, size = [np.unique(np.concatenate(out), axis=0)], 0
                        if len(out[0]) > 100_000:
                            yield pa.RecordBatch.from_arrays([pa.array(out[0][:, 0]), pa.array(out[0][:, 1])], names=["x", "y"])
                            out = []
        if out:
            u = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], names=["x", "y"])

    return run


def _groups(now: DataFrame, cap: int | None, ranges: int) -> DataFrame:
    """The rows of buckets with several components, dealt to groups of one slice of each side. now: t, x, n, p, c."""
    kinds = now.groupBy("t", "c").agg(F.count("*").alias("k"))
    mixed = kinds.groupBy("t").agg(F.sum("k").alias("rows"), F.max("k").alias("top"), F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts"))
    mixed = keep(mixed.filter("parts > 1").select("t", "rows", (F.col("rows") - F.col("top")).alias("outside"), "main"), "ngram_mixed")
    if mixed.isEmpty():
        return mixed
    slices = lambda rows: F.ceil(F.col(rows) / SLICE)
    d = now.join(F.broadcast(mixed) if fits_broadcast(mixed.count(), 96) else mixed, "t").withColumn("all_", slices("rows")).withColumn("out_", slices("outside"))
    mine = lambda salt, parts: F.pmod(F.xxhash64("x", F.lit(salt)), F.col(parts))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    outside = d.filter(F.col("c") != F.col("main"))
    if cap is None:
        every = d.select("t", F.lit(0).alias("side"), "x", "n", "p", "c", "all_", mine(1, "all_").alias("i"), F.explode(upto("out_")).alias("j"))
        few = outside.select("t", F.lit(1).alias("side"), "x", "n", "p", "c", "all_", F.explode(upto("all_")).alias("i"), mine(2, "out_").alias("j"))
    else:
        none = F.lit(0).cast("long").alias("j")
        some = F.when(F.col("all_") <= SOME, upto("all_")).otherwise(F.array_distinct(F.array(*(mine(3 + k, "all_") for k in range(SOME)))))
        every = d.select("t", F.lit(0).alias("side"), "x", "n", "p", "c", "all_", mine(1, "all_").alias("i"), none)
        few = outside.select("t", F.lit(1).alias("side"), "x", "n", "p", "c", "all_", F.explode(some).alias("i"), none)
    most = F.greatest(F.lit(1), F.ceil(F.lit(cap or 0) / F.least("all_", F.lit(SOME)))).cast("int")
    dealt = every.unionByName(few).select(F.xxhash64("t", "i", "j").alias("g"), "side", "x", "n", "p", "c", most.alias("most"))
    return dealt.repartition(ranges, "g")


def _suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose counts by hash class allow the overlap: it can't exceed the sum of the classes' smaller counts."""
    for b in batches:
        if not b.num_rows:
            continue
        a, z = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u4").reshape(-1, PARTS).astype(np.int64) for i in (2, 3))
        ok = 9 * np.minimum(a, z).sum(1) >= 4 * (a.sum(1) + z.sum(1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array(ok))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["f", "s"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for s, t in zip(b.column(2), b.column(3), strict=True):
            a, z = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
            both = np.concatenate([a, z])
            both.sort(kind="stable")
            ok.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes that link, with the same components as all of them; no pair is looked at twice."""
    sig = nodes.select("x", "sig", "doc")
    near = pairs.join(sig.select("x", F.col("sig").alias("sx")), "x").join(sig.select(F.col("x").alias("y"), F.col("sig").alias("sy")), "y")
    near = Kept(near.select("x", "y", "sx", "sy").mapInArrow(lean(_suffix), "x long, y long"), "ngram_near")
    ends = Kept(near.df.select("x").unionAll(near.df.select(F.col("y").alias("x"))).distinct(), "ngram_ends")
    few = F.broadcast(ends.df) if fits_broadcast(ends.df.count(), 32) else ends.df
    wanted = Kept(sig.join(few, "x", "left_semi").select(F.col("doc").alias("doc_id")).distinct(), "ngram_wanted")
    these = F.broadcast(wanted.df) if fits_broadcast(wanted.df.count(), 32) else wanted.df
    found = docs.join(these, "doc_id", "left_semi").select("text").mapInArrow(lean(_sets), "f long, s binary")
    sets = Kept(found.select(F.col("f").alias("x"), "s").join(few, "x", "left_semi"), "ngram_sets")
    done = [near, ends, wanted, sets]
    # rows that repeat a doc_id may bring the same set more than once: pairs are then verified again, unless that grows
    if sets.df.count() > 2 * sets.df.select("x").distinct().count():
        sets = Kept(sets.df.dropDuplicates(["x"]), "ngram_sets")
        done.append(sets)
    del found
    left, links, n_ends, these = near.df, None, ends.df.count(), sets.df
    for _ in range(THIN):
        if left.count() <= 2 * n_ends:
            break
        some = Kept(left.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "ngram_some")
        new = keep(_linked(some.df, these), "ngram_links")
        links = new if links is None else links.unionAll(new)
        rest = Kept(_apart(left.join(some.df, ["x", "y"], "left_anti"), links), "ngram_apart")
        left = rest.df
        # of the sets only those that are still asked for are sent again
        ends = Kept(left.select("x").unionAll(left.select(F.col("y").alias("x"))).distinct(), "ngram_ends")
        n_ends, done = ends.df.count(), [*done, some, rest, ends]
        these = sets.df.join(F.broadcast(ends.df) if fits_broadcast(n_ends, 32) else ends.df, "x", "left_semi")
    if n_ends or links is None:
        new = keep(_linked(left, these), "ngram_links")
        links = new if links is None else links.unionAll(new)
    tidy(docs.sparkSession, *done)
    return links


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets link."""
    both = pairs.join(sets.select(F.col("x").alias("y"), F.col("s").alias("sy")), "y").join(sets.select("x", F.col("s").alias("sx")), "x")
    return both.select("x", "y", "sx", "sy").mapInArrow(lean(_verify), "x long, y long")


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose ends the links leave in different components."""
    of = keep(components(links, "x", "y"), "ngram_parts")
    named = pairs.join(of.select(F.col("v").alias("x"), F.col("component").alias("cx")), "x", "left").join(of.select(F.col("v").alias("y"), F.col("component").alias("cy")), "y", "left")
    return named.filter(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select("x", "y")


def join_ngrams(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id. docs must be readable again (a table), since sets are not stored."""
    spark = docs.sparkSession
    ship(spark)
    with small_batches(spark, BATCH_ROWS):
        return _join(spark, docs)


def _join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = keep(docs.mapInArrow(lean(_scan), "kind int, doc_id long, n long, f long, sig binary, r int, cells binary"), "ngram_scan")
    members = scan.filter("kind = 0").select("doc_id", "n", "f")
    cells = scan.filter("kind = 1").select("r", "cells")
    tasks = len(scan.inputFiles())
    if tasks > 64:  # in two steps, so that no task reads what all of them counted
        few = int(tasks**0.5)
        cells = cells.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(few))).repartition((CELLS >> 16) * few, "r", "part").select("r", "cells").mapInArrow(lean(_sum_cells(False)), "r int, cells binary")
    ranked = cells.repartition(CELLS >> 16, "r").mapInArrow(lean(_sum_cells(True)), "r int, cells binary")
    classes = np.zeros(CELLS, np.uint8)
    for row in ranked.collect():  # CELLS bytes, whatever the input
        classes[row["r"] << 16 : (row["r"] + 1) << 16] = np.frombuffer(row["cells"], np.uint8)
    shared = spark.sparkContext.broadcast(classes)
    nodes = scan.filter("kind = 0 and n > 0 and doc_id is not null").groupBy(F.col("f").alias("x")).agg(F.first("n").alias("n"), F.min("doc_id").alias("doc"), F.first("sig").alias("sig"))
    nodes = keep(nodes, "ngram_nodes")
    total = nodes.agg(F.sum("n").alias("grams"), F.count("*").alias("rows")).first()
    bytes_ = ((total["grams"] or 0) // 5 + total["rows"]) * POST.itemsize
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bytes_ // RANGE_BYTES + 1)
    dealt = docs.filter("doc_id is not null").select("text").mapInArrow(lean(_posting(shared, ranges, SALT_ROWS)), "r long, posts binary").repartition(ranges, "r")
    buckets = Kept(dealt.mapInArrow(lean(_buckets), "kind int, f long, n long, g long, m long"), "ngram_buckets")
    found = buckets.df
    rest = keep(found.filter("kind = 1").select(F.col("g").alias("t"), F.col("f").alias("x"), "n", F.col("m").alias("p")).distinct(), "ngram_rest")
    pairs = found.filter("kind = 0").select(F.col("f").alias("x"), F.col("g").alias("y"))
    pairs = keep(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x <> y").distinct(), "ngram_pairs")
    del dealt, found
    tidy(spark, buckets)
    links = _links(pairs, nodes, docs)
    first = keep(components(links, "x", "y"), "ngram_first")

    for cap in (*CAPS, None):
        now = rest.join(first.select(F.col("v").alias("x"), "component"), "x", "left").select("t", "x", "n", "p", F.coalesce("component", "x").alias("c"))
        groups = _groups(keep(now, "ngram_rest"), cap, ranges)
        if groups.isEmpty():
            break
        dealt = groups.mapInArrow(lean(_across(cap is not None)), "x long, y long").distinct()
        more = keep(dealt.join(pairs, ["x", "y"], "left_anti"), "ngram_pairs")
        if more.isEmpty():
            continue
        new = _links(more, nodes, docs)
        pairs, links = pairs.unionAll(more), links.unionAll(new)
        first = keep(components(links, "x", "y"), "ngram_components")
    named = nodes.select("x", "doc").join(first.select(F.col("v").alias("x"), "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    named = keep(named, "ngram_named")
    least = named.groupBy(F.col("component").alias("c")).agg(F.min("doc").alias("least"))
    named = named.join(least, F.col("component") == F.col("c")).select("x", F.col("least").alias("component"))
    out = members.join(named, (F.col("f") == F.col("x")) & (F.col("n") > 0), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id (all its rows, and all rows with a null id); columns as in docs.

    whole: (doc_id, text) of the same documents before an earlier stage cut them (other ids are ignored).  Documents then link
    if either their present or their whole texts do, so that what is left of a near copy goes with it.
    """
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    if whole is None:
        groups = join_ngrams(now)
    else:
        hashed = lambda d: d.select("doc_id", F.xxhash64("text").alias("h")).distinct()
        before = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        cut = keep(hashed(before).join(hashed(now), ["doc_id", "h"], "left_anti").join(now.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").distinct(), "ngram_cut")
        cut = F.broadcast(cut) if fits_broadcast(cut.count(), 32) else cut
        both = now.unionAll(keep(before.join(cut, "doc_id", "left_semi"), "ngram_whole"))
        links = keep(join_ngrams(both).select("doc_id", "component_id"), "ngram_versions")
        groups = components(links, "doc_id", "component_id").select(F.col("v").alias("doc_id"), F.col("component").alias("component_id"))
    copies = keep(groups.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("doc_id")).distinct(), "ngram_copies")
    copies = F.broadcast(copies) if fits_broadcast(copies.count(), 32) else copies
    return _without(docs, copies)


def _without(docs: DataFrame, copies: DataFrame) -> DataFrame:
    return docs.join(copies, docs["doc_id"] == copies["doc_id"], "left_anti")
