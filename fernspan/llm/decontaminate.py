"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact weighted shingles, in DataFrame functions only.

Texts become words (lower-case runs of letters and digits).  An item's shingles are its runs of ``SHINGLE`` words (the whole
sequence, if shorter); a shingle weighs ln(1 + items / items that have it).  A document contains an item if an item-sized
window of it (as many words as the item, and a fifth of slack on either side) holds shingles of ``THRESHOLD`` or more
of the item's weight; the similarity reported is that of the best such window.

What is fingerprinted (60-bit SimHash of the words) is every window of ``SHINGLE`` words, not of the item's length: one edited
word moves an item-sized fingerprint by more bits than multi-index blocks can follow (figures in the README), while a window
at the threshold must hold some shingles whole.  Fingerprints are cut into ``RADIUS + 1`` blocks; two within ``RADIUS`` bits agree in
one block at least, so equality of (block, value) finds all of them and the bit count of the difference decides.  Of these,
windows with an item's shingle's words are matches, in any order and, of ``SHINGLE`` words, all but one.  Rare first: a window at the threshold misses a fifth
of an item's weight at most, so it holds one of the item's rarest shingles that make up more than that; only
documents with such a match are candidates for the item.  Their matches in order of place, with a sliding frame as wide as the
item-sized window, give the exact best window.  Nothing at or above the threshold is lost.

Scale: texts are read once and nothing of the documents is shuffled but matches; the items' fingerprints are broadcast while
their counted rows fit ``BROADCAST_BYTES``, and are a shuffle join beyond.

Defined results: null and empty texts contain nothing; items without words match nothing; rows that repeat an item_id are one
item with several texts, any of which may be found; a passage without an item_id is an item of its own, which counts but can't be
named; rows with a null doc_id are never contaminated; rows that share a doc_id are
reported each, with what any of them contains; very long texts are read whole, their matches are what one task sorts; other
columns pass through, whatever their names; empty tables give clean documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernspan.session import fits_broadcast, keep

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 1
BLOCKS = RADIUS + 1
#: Sums of weights are compared with this much slack, since their order varies.
EPSILON = 1e-9
_ONES = 0x0111111111111111


def words_hashed(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def simhash(hashes: list[Column]) -> Column:
    """Bit by bit the majority over fewer than 16 hashes, 60 bits: counters four bits wide, fifteen to a long, are added at a time."""
    w, out = len(hashes), None
    for j in range(4):
        lane = reduce(lambda x, y: x + y, (F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_ONES)) for h in hashes))
        # a counter above w / 2 reaches 8, and no counter reaches 16
        bit = F.shiftleft(F.shiftrightunsigned((lane + F.lit((7 - w // 2) * _ONES)).bitwiseAND(F.lit(8 * _ONES)), 3), j)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def blocks(fp: Column, k: int) -> Column:
    """One key for each block: words of the window, number of the block and its bits."""
    width = 60 // BLOCKS
    return F.array(*(F.shiftrightunsigned(fp, width * b).bitwiseAND(F.lit((1 << width) - 1)) + F.lit((k * BLOCKS + b) << width) for b in range(BLOCKS)))


def windows(df: DataFrame, ids: list[str], k: int) -> DataFrame:
    """ids, pos (first word), sh (hash), fp (SimHash), key (one row a block): every window of k words of the hashed words H."""
    h = [f"__h{j}" for j in range(k)]
    d = df.select(*ids, *(F.slice("H", j + 1, F.size("H")).alias(x) for j, x in enumerate(h)))
    # outer, since a filter on the size of what a plain explode takes would hash the words twice
    d = d.select(*ids, F.posexplode_outer(F.arrays_zip(*h)).alias("pos", "__w")).filter(F.col(f"__w.{h[-1]}").isNotNull())
    cols = [F.col(f"__w.{x}") for x in h]
    d = d.select(*ids, "pos", F.xxhash64(*cols).alias("sh"), F.array(*cols).alias("ws"), simhash(cols).alias("fp"))
    return d.select(*ids, "pos", "sh", "ws", "fp", F.explode(blocks(F.col("fp"), k)).alias("key"))


def in_common(a: Column, b: Column) -> Column:
    """How many words two windows share, repeated ones as often as both have them, in any order."""
    times = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(times(a, w), times(b, w)))


def alike(ws: Column, item_ws: Column) -> Column:
    """Of windows whose fingerprints are near: all words in common, or of ``SHINGLE`` words all but one."""
    least = F.when(F.size(item_ws) >= SHINGLE, F.size(item_ws) - 1).otherwise(F.size(item_ws))
    return in_common(ws, item_ws) >= least


def prepared_items(benchmark: DataFrame) -> DataFrame:
    """item, item_id, tid, sh, fp, key, k, weight, total, rare, reach (how far beyond its first shingle an item-sized window may hold another).

    item is the id as a string, or tells a text without one by its words.
    """
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", words_hashed(F.col("text")).alias("H"))
    items = items.withColumn("n", F.size("H")).filter("n > 0").withColumn("tid", F.xxhash64("H"))
    items = items.withColumn("item", F.coalesce(F.col("item_id").cast("string"), F.concat(F.lit("text "), F.hex("tid")))).dropDuplicates(["item", "tid"])
    items = keep(items.withColumn("k", F.least(F.col("n"), F.lit(SHINGLE))), "bench_items")
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # SHINGLE rows at most
    if not sizes:
        return items.select("item", "k").limit(0)
    ids = ["item", "item_id", "tid", "n", "k"]
    long = reduce(DataFrame.unionAll, (windows(items.filter(F.col("k") == k), ids, k) for k in sizes))
    long = keep(long.drop("pos").distinct(), "bench_shingles")
    count = float(items.select("item").distinct().count())
    df = long.groupBy("k", "sh").agg(F.count_distinct("item").alias("df"))
    once = long.select(*ids, "sh").distinct().join(df, ["k", "sh"]).withColumn("weight", F.log(1 + F.lit(count) / F.col("df")))
    one = Window.partitionBy("item", "tid")
    before = F.coalesce(F.sum("weight").over(one.orderBy(F.col("weight").desc(), "sh").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    once = once.withColumn("total", F.sum("weight").over(one)).withColumn("before", before)
    rare = F.col("before") <= (1 - THRESHOLD) * F.col("total") + EPSILON
    slack = F.floor(F.col("n") / 5) + 1
    once = once.select("item", "tid", "sh", "weight", "total", rare.alias("rare"), (F.col("n") + 2 * slack - F.col("k")).cast("long").alias("reach"))
    return keep(long.select("item", "item_id", "tid", "k", "sh", "ws", "fp", "key").join(once, ["item", "tid", "sh"]), "bench_weighed")


def _sized(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df.count(), row_bytes) else df


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity) of every item found, of the most similar window of each pair; item_id is null for passages without one."""
    items = prepared_items(benchmark)
    sizes = [r["k"] for r in items.select("k").distinct().collect()]
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double")
    base = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    hashed = base.select("doc_id", F.xxhash64("text").alias("row"), words_hashed(F.col("text")).alias("H"))
    marks = _sized(keep(items.select("key", F.col("fp").alias("item_fp"), F.col("sh").alias("item_sh"), F.col("ws").alias("item_ws")).distinct(), "bench_marks"), 160)
    near = reduce(DataFrame.unionAll, (windows(hashed, ["doc_id", "row"], k) for k in sizes)).join(marks, "key")
    near = near.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).filter((F.col("sh") == F.col("item_sh")) | alike(F.col("ws"), F.col("item_ws")))
    # the blocks of one window may all agree; a match goes by the item's shingle
    hits = keep(near.select("doc_id", "row", "pos", F.col("item_sh").alias("sh")).distinct(), "bench_hits")
    own = keep(items.select("item", "item_id", "tid", "sh", "weight", "total", "rare", "reach").distinct(), "bench_own")
    few = own.filter("rare").select("sh", "item", "tid")
    pairs = keep(hits.select("doc_id", "row", "sh").distinct().join(_sized(few, 96), "sh").select("doc_id", "row", "item", "tid").distinct(), "bench_pairs")
    found = hits.join(_sized(own.drop("rare"), 128), "sh").join(_sized(pairs, 96), ["doc_id", "row", "item", "tid"], "left_semi")
    # places in units of an item's reach, so that one frame fits all items; the next place beyond it lies 1 / reach further
    widest = own.agg(F.max("reach")).first()[0] or 1
    found = found.withColumn("at", F.col("pos") / F.greatest("reach", F.lit(1)))
    frame = f"(PARTITION BY doc_id, row, item, tid ORDER BY at RANGE BETWEEN CURRENT ROW AND {1 + 0.5 / max(widest, 1):.15f}D FOLLOWING)"
    found = found.select("doc_id", "item", "item_id", "total", F.expr(f"collect_set(struct(sh, weight)) OVER {frame}").alias("held"))
    held = F.aggregate("held", F.lit(0.0), lambda acc, x: acc + x["weight"])
    scored = found.select("doc_id", "item", "item_id", (held / F.col("total")).alias("similarity")).filter(F.col("similarity") >= THRESHOLD - EPSILON)
    return keep(scored.groupBy("doc_id", "item", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity")).drop("item"), "bench_found")


def _by_document(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(found_id, n_found, item_ids, max_similarity) of the documents that contain something."""
    found = contaminated(docs, benchmark)
    by_doc = found.groupBy(F.col("doc_id").alias("found_id")).agg(F.count("*").alias("n_found"), F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("similarity").alias("max_similarity"))
    return F.broadcast(by_doc) if fits_broadcast(found.count(), 64) else by_doc


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, item_ids (of those that have one), max_similarity (null if clean)."""
    d = docs.select("doc_id")
    d = d.join(_by_document(docs, benchmark), F.col("doc_id") == F.col("found_id"), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return d.select("doc_id", F.col("found_id").isNotNull().alias("contaminated"), F.coalesce("n_found", F.lit(0)).cast("long").alias("n_items"), ids.alias("item_ids"), "max_similarity")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark passage, with their own columns."""
    bad = _by_document(docs, benchmark).select("found_id")
    return docs.join(bad, docs["doc_id"] == bad["found_id"], "left_anti")
