"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A text is cut into lines at line breaks and, since running prose has few of them, after clause punctuation followed by white
space (or full-width punctuation); clauses of more than ``LONG`` bytes are cut again at about one in five of their spaces, by
the letters beside them; a cut depends on its own clause only, and the cuts keep every character, so the lines joined are the
text.  Each line is hashed; a rolling hash covers a line and the next; two lines are a chunk if their hash
is the least of some ``SPAN`` in a row that it is among.  Chunks hence depend on a dozen lines around them only, shift with the
text they belong to, and every passage of ``SPAN`` + 1 whole lines holds one, the same in each copy.  Chunks whose hash occurs
more than once anywhere are read again with their text and grouped by hash and the text itself, which compares their bytes.
Of each group the occurrence with the smallest (doc_id, text hash, line) stays, every other one is removed, and with it up to
``EDGE`` lines on either side whose 64-bit hashes are those beside the first: a repeated passage begins and ends between
boundaries, no more than so many whole lines from one. (Chunks are compared by bytes; these few lines beside a proven chunk by
hash, since carrying their text made the shuffles three times as large.)

Scale: neighbours of a line are looked at in rows of their own, beside each other, so that no text is gone through twice a pass.
The first shuffle carries 8-byte chunk keys with map-side counts, the second the text of repeated chunks only, with
map-side grouping, so a chunk that a third of all documents share arrives as one row a task.  Which chunks may repeat is told by a
bitmap of ``BITS`` bits (8 MB, whatever the input) of the repeated keys; a chunk that shares its bit with one is found to be alone
when chunks are grouped, so results are exact at any size.  Removal lists are broadcast only while the hash table of their
counted rows fits ``MOST_BYTES``, else they are a shuffle join (skew split by AQE).

Defined results: null texts stay null and empty texts empty; rows with a null doc_id pass unchanged; rows that agree in
doc_id and text are one document (both rows get the same result); very long texts are read whole, one row at a time; other
columns pass through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernspan.llm.names import col, free
from fernspan.session import Kept, keep, tidy

#: Cuts after a line break, after clause punctuation and a space, and after full-width punctuation.
CLAUSE_CUT = r"(?<=\n)|(?<=[.!?,;:] )(?![ \t\n])|(?<=[。！？，、；：])(?![ \t\n])"
#: Clauses of more bytes than this are cut again, at about one in five of their spaces, by the letters beside them.
LONG = 60
LONG_CUT = r"(?<=[aeiou] )(?=[a-m])"


#: The same cuts told by what lies between them, so that runs without a mark are gone through without looking back at every character.
_WIDE = "。！？，、；："
_CLAUSE = rf"(?s)(?=.)(?:[^\n.!?,;:、-；]+|[.!?,;:](?! (?![ \t\n]))|[{_WIDE}](?=[ \t\n])|[、-；&&[^{_WIDE}]])*+(?:[.!?,;:] |.)?"
_PIECE = r"(?s)(?=.)(?:[^ ]+| (?<![aeiou] )| (?![a-m]))*+ ?"
#: Ends of texts after which an empty line follows.
_OPEN_END = rf"(?s)(?:\n|[.!?,;:] |[{_WIDE}])\z"


def lines_of(text: Column) -> Column:
    """A text's lines, as the two cuts make them; joined, they are the text."""
    clauses = F.regexp_extract_all(text, F.lit(_CLAUSE), F.lit(0))
    clauses = F.when((text == "") | F.right(text, F.lit(2)).rlike(_OPEN_END), F.concat(clauses, F.array(F.lit("")))).otherwise(clauses)
    return F.flatten(F.transform(clauses, lambda x: F.when(F.octet_length(x) > LONG, F.regexp_extract_all(x, F.lit(_PIECE), F.lit(0))).otherwise(F.array(x))))


#: Lines of a chunk, and rolling hashes in a row of which one is a chunk's.
MIN_LINES = 2
SPAN = 4
#: Lines beside a repeated chunk, on either side, that go with it if they are those beside its first occurrence.
EDGE = SPAN - 1
#: Bits of the bitmap of repeated keys.
BITS = 1 << 26
#: Bytes that a row of a few numbers takes in the hash table of a broadcast join, about, and the most that one takes.
ROW_BYTES, MOST_BYTES = 112, 32 << 20
_NEAR = range(1 - SPAN, SPAN + MIN_LINES - 1)
#: Columns with the hashes of the lines beside a chunk, by their distance from its first line.
_SIDES = {-k: f"before{k}" for k in range(1, EDGE + 1)} | {MIN_LINES - 1 + k: f"after{k}" for k in range(1, EDGE + 1)}


def _chunks(docs: DataFrame, texts: bool = False) -> DataFrame:
    """(doc_id, tid, start, key) of every chunk; with texts also its bytes and the hashes of the lines beside it. docs: doc_id, tid, text."""
    d = docs.select("doc_id", "tid", lines_of(F.col("text")).alias("lines"))
    d = d.select("doc_id", "tid", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"))

    def moved(column: str, by: int) -> Column:
        none = F.lit(None).cast("long" if column == "h" else "string")
        return F.concat(F.array(*[none] * -by), F.col(column)) if by < 0 else F.slice(column, by + 1, F.size(column))

    named = lambda x, by: f"{x}{by}".replace("-", "_")
    cols = {named("h", k): moved("h", k) for k in _NEAR} | {named("l", k): moved("lines", k) for k in range(MIN_LINES if texts else 0)}
    d = d.select("doc_id", "tid", *(c.alias(x) for x, c in cols.items()))
    # outer, since the optimiser sends a filter on the size of what a plain explode takes below, and all that made it with it
    d = d.select("doc_id", "tid", F.posexplode_outer(F.arrays_zip(*cols)).alias("start", "x")).select("doc_id", "tid", "start", "x.*")
    d = d.filter(F.col("h0").isNotNull() & F.col("h1").isNotNull())
    pair = lambda k: F.when(F.col(named("h", k)).isNotNull() & F.col(named("h", k + 1)).isNotNull(), F.xxhash64(named("h", k), named("h", k + 1)))
    d = d.select("*", *(pair(k).alias(named("r", k)) for k in range(1 - SPAN, SPAN)))

    def run(step: int) -> Column:
        """How many rolling hashes on this side, in a row, are no less; the text's end counts as no less."""
        out = F.lit(0)
        for k in range(SPAN - 1, 0, -1):
            out = F.when(F.coalesce(F.col("r0") <= F.col(named("r", step * k)), F.lit(True)), out + 1).otherwise(0)
        return out

    chosen = run(-1) + run(1) >= SPAN - 1
    d, key = d.filter(chosen), F.col("r0").alias("key")
    if not texts:
        return d.select("doc_id", "tid", "start", key)
    # columns of their own, since arrays would cost more than all the rest
    sides = [F.col(named("h", k)).alias(x) for k, x in _SIDES.items()]
    return d.select("doc_id", "tid", "start", key, F.concat("l0", "l1").alias("bytes"), *sides)


def _bitmap(keys: DataFrame) -> DataFrame:
    """One row, bits: an array of BITS / 64 numbers with a bit set for every key. keys: key."""
    words = keys.groupBy(_word("key").alias("word")).agg(F.bit_or(_bit("key")).alias("bits")).toArrow()  # BITS / 64 rows at most
    bits = np.zeros(BITS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    one = pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))})
    return keys.sparkSession.createDataFrame(one)


def _word(key: str) -> Column:
    return F.pmod(F.shiftright(key, 6), F.lit(BITS // 64)).cast("int")


def _bit(key: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({key} & 63 as int))")


def _common(side: str) -> Column:
    """How many lines next to the chunk are the first occurrence's, by their hashes, from the chunk outwards."""
    out = F.lit(0)
    for k in range(EDGE, 0, -1):
        out = F.when(F.col(f"{side}{k}") == F.col(f"first_{side}{k}"), out + 1).otherwise(0)
    return out


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, gone): for each document that loses lines, their ranges (first << 32 | last). docs: doc_id, text."""
    base = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("tid"), "text")
    bitmap = _bitmap(_chunks(base).groupBy("key").agg(F.count("*").alias("seen")).filter("seen > 1").select("key"))
    may_repeat = F.get("bits", _word("key")).bitwiseAND(_bit("key")) != 0
    chunks = Kept(_chunks(base, texts=True).join(F.broadcast(bitmap), may_repeat).drop("bits"), "line_chunks")
    occurrences = chunks.df
    # chunks of blank lines are no content
    # the first occurrence brings the hashes of the lines beside it, so that no second pass looks for them
    place = ["doc_id", "tid", "start", *_SIDES.values()]
    same = occurrences.select("key", "bytes", *place).filter(F.col("bytes").rlike(r"\S")).groupBy("key", "bytes").agg(F.count("*").alias("seen"), F.min(F.struct(*place)).alias("first"))
    # two different texts under one key (a collision of 64 bits) are left alone
    proven = same.groupBy("key").agg(F.count("*").alias("texts"), F.max("seen").alias("seen"), F.first("first").alias("first")).filter("texts = 1 and seen > 1")
    firsts = Kept(proven.select("key", F.col("first.doc_id").alias("first_doc"), F.col("first.tid").alias("first_tid"), *(F.col(f"first.{x}").alias(f"first_{x}") for x in ("start", *_SIDES.values()))), "line_firsts")
    victims = occurrences.drop("bytes").join(firsts.df.hint("merge"), "key").filter("doc_id <> first_doc or tid <> first_tid or start <> first_start")
    other = (F.col("doc_id") != F.col("first_doc")) | (F.col("tid") != F.col("first_tid"))  # within one text, extending could reach the first occurrence
    from_ = F.col("start") - F.when(other, _common("before")).otherwise(0)
    to = F.col("start") + MIN_LINES - 1 + F.when(other, _common("after")).otherwise(0)
    # a range of lines in one number, so that what documents lose stays small
    ranges = F.collect_set(F.shiftleft(from_.cast("long"), 32) + to.cast("long"))
    out = keep(victims.groupBy("doc_id", "tid").agg(ranges.alias("gone")), "line_removals")
    tidy(docs.sparkSession, chunks, firsts)
    return out


def _lines_of(ranges: Column) -> Column:
    return F.flatten(F.transform(ranges, lambda x: F.sequence(F.shiftright(x, 32).cast("int"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))))


def dedup_lines(docs: DataFrame, n_removed: str = "__n_removed") -> DataFrame:
    """docs with ``text`` rewritten, plus the number of its lines that were removed (long)."""
    names = [c for c in docs.columns if c != "text"]
    lines, own, doc, tid, list_ = free(docs, "__lines", "__own", "__doc", "__tid", "__gone")
    gone = removals(docs.select("doc_id", "text"))
    few = gone.agg(F.count("*").alias("rows"), F.sum(F.size("gone")).alias("ranges")).first()
    gone = F.broadcast(gone) if few["rows"] * ROW_BYTES + (few["ranges"] or 0) * 8 <= MOST_BYTES else gone
    gone = gone.select(F.col("doc_id").alias(doc), F.col("tid").alias(tid), F.col("gone").alias(list_))
    cut = docs.withColumn(own, F.xxhash64("text")).join(gone, (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(tid)), "left")
    # texts that lose nothing are not cut; the lines are used more than once below, so they are not inlined into the lambda
    cut = cut.withColumn(lines, F.when(F.col(list_).isNotNull(), lines_of(F.col("text")))).withColumn(list_, F.array_distinct(_lines_of(F.col(list_))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(list_))
    text = F.when(F.col(list_).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), ""))
    n = F.when(F.col(list_).isNotNull(), F.size(lines) - F.size(left)).otherwise(0).cast("long")
    return cut.select(*map(col, names), text.alias("text"), n.alias(n_removed))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lines removed, characters left, digest of what is left."""
    d = dedup_lines(docs.select("doc_id", "text"))
    return d.select("doc_id", F.col("__n_removed").alias("n_removed"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated chunks taken out; one that loses all its text goes. Columns as in docs (n_chars follows the text)."""
    n_removed, row = free(docs, "__n_removed", "__row")
    # the number keeps the filter above it: sent below, it would draw the lines into the lambda that picks them
    d = dedup_lines(docs, n_removed).withColumn(row, F.monotonically_increasing_id())
    cut = F.col(n_removed) > 0
    gone = cut & (F.length(F.regexp_replace("text", r"\s+", "")) == 0)
    d = d.filter((F.col(row) >= 0) & ~F.coalesce(gone, F.lit(False)))
    now = {"n_chars": lambda: F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return d.select(*(now.get(c, lambda c=c: col(c))() for c in docs.columns))
