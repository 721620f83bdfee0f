"""Phrase collocation mining with hashed buckets (PCY / DHP) and Apriori pruning.

Three passes over the texts count phrases of one, two and three words, all by language:

1. words, exactly; and every pair of neighbours adds one to a bucket under its hash;
2. pairs, exactly, but only those whose words are both frequent and whose bucket is; every triple of which both pairs are
   left adds one to a bucket;
3. triples, exactly, but only those whose pairs are both frequent and whose bucket is.

A pass gets bitmaps by broadcast: the buckets that reached the least count in the pass before, and the hashes of the phrases
that did (Apriori).  Hashes collide, so a bitmap may let a rare phrase through, which the exact count then drops; it never drops a
frequent one.  Buckets count up to 255 and stay there, which the comparison does not notice.

Scale: a task numbers its words, sorts pairs of numbers and hands on distinct phrases with their counts, and its buckets as slices
that are not empty; slices and phrases meet under their own keys, so a phrase that is everywhere is one row a task.  A bitmap has
``BUCKETS_PER_ROW`` bits a document, rounded up to a power of two, 2^16 at least and ``MOST_BITS`` at most (8 MB): beyond that
size buckets fill up and prune less, and the words' bitmap does the work; results are the same.  The list of a language is
cut in two steps, first among ``SALTS`` parts of its candidates.

Defined results: null text is empty; a null language is ``und`` (and goes with one that is so named); only A-Z are lowered;
documents end a piece; repeated rows count each; very long texts are read whole; scores are floors of exact quotients, for counts
below 10^15; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernspan.session import Kept, lean, ship

LEAST = 10
TOP = 2000
LONGEST = 3
#: A longer phrase takes those inside it along if it has this share (in 100) of their count.
SHARE = 50
BUCKETS_PER_ROW = 64
LEAST_BITS, MOST_BITS = 16, 26
#: Cells of a slice of buckets, and parts in which a language's list is cut first.
SLICE = 1 << 14
SALTS = 64
#: Bytes of text that are split at a time; words that a task numbers, and pairs or triples that it holds, before it hands on what it has.
GROUP_BYTES = 4 << 20
WORDS = 400_000
HELD = 2_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)
NAMES = ["kind", "lang", "phrase", "n", "slice", "cells"]
SCHEMA = "kind int, lang string, phrase string, n long, slice int, cells binary"
PHRASES, BUCKETS = 0, 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _Q
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its beginning and its last word."""
    return _mix(a * _P + b)


class Bitmap:
    """Bits by hash."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class _Words:
    """A language's words as numbers, with their hashes."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {b"": -2, b"\n": -1}
        self.names: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)

    def read(self, text: bytes) -> np.ndarray:
        """The text as word numbers, -1 between pieces."""
        number, names = self.number, self.names
        words = text.translate(_LOWER).replace(b"\n", b" \n ").split(b" ")
        for w in {*words}.difference(number):
            number[w] = len(names)
            names.append(w)
        if more := names[len(self.hashes) :]:
            self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(w, seed=self.seed) for w in more), np.uint64, len(more))])
            self.counts = np.concatenate([self.counts, np.zeros(len(more), np.int64)])
        out = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        return out[out > -2]


class _Counter:
    """What a task has of one language: pairs or triples of word numbers waiting to be counted."""

    def __init__(self, lang: str, size: int):
        self.lang, self.size, self.words = lang, size, _Words(lang)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, *parts: np.ndarray) -> None:
        self.waiting.append(parts)
        self.held += len(parts[0])

    def full(self) -> bool:
        return self.held > HELD or len(self.words.names) > WORDS

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = self.words.names
        if self.size == 1:
            phrases, n = names, self.words.counts
        elif self.waiting:
            cols = [np.concatenate(c) for c in zip(*self.waiting, strict=True)]
            width = max(len(names), 1)
            begin, key = np.unique(cols[0] * width + cols[1], return_inverse=True)
            if self.size == 3:
                key, n = np.unique(key * width + cols[2], return_counts=True)
                key, third = np.divmod(key, width)
                parts = [*np.divmod(begin[key], width), third]
            else:
                n = np.bincount(key, minlength=len(begin))
                parts = [*np.divmod(begin, width)]
            phrases = [b" ".join(p) for p in zip(*([names[i] for i in p.tolist()] for p in parts), strict=True)]
        else:
            phrases, n = [], np.zeros(0, np.int64)
        self.words.clear()
        self.waiting, self.held = [], 0
        for at in range(0, len(phrases), 100_000):
            some = phrases[at : at + 100_000]
            k = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([PHRASES] * k, pa.int32()), pa.array([self.lang] * k), pa.array(some, pa.binary()).cast(pa.string()), pa.array(n[at : at + k].astype(np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=NAMES)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of a language, some megabytes at a time, a piece's end between them."""
    for b in batches:
        by: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if text:
                by.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] > GROUP_BYTES:
                    yield lang, b"\n".join(by.pop(lang))
                    sizes[lang] = 0
        for lang, texts in by.items():
            yield lang, b"\n".join(texts)


def _pass(size: int, bits: int, before: Bitmap | None, buckets: Bitmap | None, alone: Bitmap | None) -> Callable:
    """Counts phrases of ``size`` words, and buckets (2^bits of them) of phrases of one word more.

    before: frequent phrases of one word less, exact but for hashing; buckets: of phrases of this size; alone: frequent words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, _Counter] = {}
        cells = np.zeros(1 << bits, np.uint8) if size < LONGEST else None
        hashes: list[np.ndarray] = []
        n_hashes = 0

        def pour() -> None:
            nonlocal n_hashes
            if hashes:
                at, n = np.unique(np.concatenate(hashes) & np.uint64((1 << bits) - 1), return_counts=True)
                at = at.astype(np.int64)
                cells[at] = np.minimum(cells[at] + n, 255)
                hashes.clear()
                n_hashes = 0

        for lang, text in _groups(batches):
            c = counters.get(lang)
            if c is None:
                c = counters[lang] = _Counter(lang, size)
            w = c.words.read(text)
            inside = w >= 0
            h = np.where(inside, c.words.hashes[np.maximum(w, 0)] if len(c.words.names) else np.uint64(0), np.uint64(0))
            if size == 1:
                c.words.counts += np.bincount(w[inside], minlength=len(c.words.names))
                two = inside[:-1] & inside[1:]
                longer = joined(h[:-1][two], h[1:][two])
            else:
                fine = inside & alone.has(h)
                two = fine[:-1] & fine[1:]
                at = np.flatnonzero(two)
                pair = joined(h[at], h[at + 1])
                ok = (buckets if size == 2 else before).has(pair)
                at, pair = at[ok], pair[ok]
                next_to = np.flatnonzero(at[1:] == at[:-1] + 1)  # pairs left that follow each other are triples
                triple = joined(pair[next_to], h[at[next_to] + 2])
                if size == 2:
                    c.add(w[at], w[at + 1])
                    longer = triple
                else:
                    first = at[next_to][buckets.has(triple)]
                    c.add(w[first], w[first + 1], w[first + 2])
                    longer = None
            if longer is not None and len(longer):
                hashes.append(longer)
                if (n_hashes := n_hashes + len(longer)) > HELD:
                    pour()
            if c.full():
                yield from c.rows()
        for c in counters.values():
            yield from c.rows()
        if cells is not None:
            pour()
            rows = [(i, p.tobytes()) for i in range(max(1, (1 << bits) // SLICE)) if (p := cells[i * SLICE : (i + 1) * SLICE]).any()]
            k = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([BUCKETS] * k, pa.int32()), pa.nulls(k, pa.string()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=NAMES)

    return run


def _sum_slices(least: int) -> Callable:
    """Tasks' slices of the same number added up; which cells reach the least count, as bits."""
    least = min(least, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(cells, np.uint8)
                sums[i] = np.minimum(sums[i] + x, least).astype(np.uint16) if i in sums else np.minimum(x, least).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([np.packbits(s >= least, bitorder="little").tobytes() for s in sums.values()], pa.binary())], names=["slice", "bits"])

    return run


def _frequent_slices(bits: int) -> Callable:
    """A task's frequent phrases as bits under their hashes, by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << bits, bool)
        for b in batches:
            if not b.num_rows:
                continue
            seeds = [xxhash.xxh3_64_intdigest(lang.encode()) for lang in b.column(0).to_pylist()]
            places = zip(*(phrase.encode().split(b" ") for phrase in b.column(1).to_pylist()), strict=True)
            hashes = [np.fromiter((xxhash.xxh3_64_intdigest(w, seed=s) for w, s in zip(p, seeds, strict=True)), np.uint64, len(seeds)) for p in places]
            h = hashes[0]
            for x in hashes[1:]:
                h = joined(h, x)
            out[(h & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        rows = [(i, np.packbits(p, bitorder="little").tobytes()) for i in range(max(1, (1 << bits) // SLICE)) if (p := out[i * SLICE : (i + 1) * SLICE]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "bits"])

    return run


def _or_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: dict[int, np.ndarray] = {}
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(x, np.uint8)
            got[i] = got[i] | x if i in got else x
    yield pa.RecordBatch.from_arrays([pa.array([*got], pa.int32()), pa.array([x.tobytes() for x in got.values()], pa.binary())], names=["slice", "bits"])


def _bitmap(slices: DataFrame, bits: int) -> Bitmap:
    """Slices of bits, one row each, as one bitmap on the driver: 2^bits bits, 8 MB at most."""
    width = min(SLICE, 1 << bits) // 8
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in slices.collect():
        x = np.frombuffer(r["bits"], np.uint8)
        out[r["slice"] * width : r["slice"] * width + len(x)] = x
    return Bitmap(out)


def bits_for(rows: int) -> int:
    return min(max((BUCKETS_PER_ROW * max(rows, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[list[Kept], DataFrame]:
    """Tables (lang, phrase, f) of the frequent phrases of one, two and three words, and (lang, n) with all words counted."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    bits = bits_for(docs.count())
    found: list[Kept] = []
    totals = before = buckets = alone = None
    for size in range(1, LONGEST + 1):
        raw = Kept(texts.mapInArrow(lean(_pass(size, bits, before, buckets, alone)), SCHEMA), f"phrases_{size}")
        counts = raw.df.filter(F.col("kind") == PHRASES).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if size == 1:
            totals = Kept(raw.df.filter(F.col("kind") == PHRASES).groupBy("lang").agg(F.sum("n").alias("n")), "phrase_totals").df
        found.append(Kept(counts.filter(F.col("f") >= least), f"frequent_{size}"))
        if size < LONGEST:
            buckets = _bitmap(raw.df.filter(F.col("kind") == BUCKETS).select("slice", "cells").repartition("slice").mapInArrow(lean(_sum_slices(least)), "slice int, bits binary"), bits)
            before = _bitmap(found[-1].df.select("lang", "phrase").mapInArrow(lean(_frequent_slices(bits)), "slice int, bits binary").repartition("slice").mapInArrow(lean(_or_slices), "slice int, bits binary"), bits)
            alone = alone or before
        raw.drop()
    return found, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """Per language its best phrases: lang, rank, phrase, a, l, r, n, score."""
    (one, two, three), totals = frequent_phrases(docs, least)
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    part = lambda df, name, f: df.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    words = F.split("phrase", " ")

    def cut(df: DataFrame, k: int, first: DataFrame, rest: DataFrame, size: int) -> DataFrame:
        x = df.select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("first"), F.array_join(F.slice(words, k + 1, size - k), " ").alias("rest"))
        x = x.join(part(first, "first", "l"), ["lang", "first"]).join(part(rest, "rest", "r"), ["lang", "rest"])
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a"), exact("l") * exact("r"))  # whole numbers throughout
        return x.select("lang", "phrase", "a", "k", "l", "r", score.cast("long").alias("score"))

    pairs = cut(two.df, 1, one.df, one.df, 2)
    triples = cut(three.df, 1, one.df, two.df, 3).unionByName(cut(three.df, 2, two.df, one.df, 3))
    best = triples.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.k", "b.l", "b.r", "b.score")
    inner = three.df.select("lang", F.explode(F.array_distinct(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " ")))).alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    pairs = pairs.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    every = pairs.unionByName(best).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    cut_off = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return cut_off.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM worded, range(1, 4) AS s(m), range(1, len(w) - m + 2) AS t(i)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS rest
  FROM f, range(1, 3) AS c(k) WHERE m > k),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST((1000000 :: HUGEINT * c.a * c.a) // (x.f :: HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first AND x.m = c.k JOIN f y ON y.lang = c.lang AND y.phrase = c.rest AND y.m = c.m - c.k
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1),
longer AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS phrase, max(f) AS f FROM f, range(1, 3) AS t(i) WHERE m = 3 GROUP BY ALL),
left_over AS (
  SELECT s.* FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase AND s.m = 2 WHERE g.f IS NULL OR 100 * g.f < {SHARE} * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM left_over JOIN n USING (lang) QUALIFY rank <= {TOP}"""
