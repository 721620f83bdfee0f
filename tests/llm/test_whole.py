"""Operators read all of their input: tests of what a cut would lose."""

import collections
import random
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fernspan.llm import line_dedup, secrets, toxicity
from fernspan.session import scratch_path
from tests.llm.test_llm import line_cuts


def letters(r, n, alphabet="abcdefghiklmnop"):
    return "".join(r.choice(alphabet) for _ in range(n))


def test_toxicity_reads_whole_words(spark):
    assert sum(len(rows) for rows, *_ in toxicity.events(["harmlessslorgak", "ab", "x" * 70_000])) == 16 + 3 + 70_001
    r = random.Random(21)
    rows = [(" ".join(letters(r, 6) for _ in range(20)) + (" harmlessslorgak" if k % 3 == 0 else " harmlessmeadows"), int(k % 3 == 0)) for k in range(150)]
    model = toxicity.fit_counts(spark.createDataFrame(rows, "text string, toxic int"))
    bad, good = model.ratios(["harmlessslorgak", "harmlessmeadows"])
    assert bad > good + 3


def grams_of(w):
    c = "\0" * 6 + "\2" + w + "\3"
    return [c[i - 7 : i + 1] for i in range(7, len(c))]


def test_toxicity_counts_are_exact(spark):
    """Ratios equal Kneser-Ney in plain dictionaries."""
    r = random.Random(22)
    rows = [(" ".join(letters(r, r.randint(1, 14)) for _ in range(60)), k % 2) for k in range(150)]
    model = toxicity.fit_counts(spark.createDataFrame(rows, "text string, toxic int"))
    grams = {}
    for text, y in rows:
        for w in text.split():
            for g in grams_of(w):
                grams.setdefault(g, [0, 0])[y] += 1
    sums, threes = collections.defaultdict(lambda: np.zeros(6)), collections.Counter()
    for g, (a, b) in grams.items():
        sums[g[:-1]] += (a, b, a > 0, b > 0, a + b, 1)
        threes[g[-3:]] += 1
    twos, after = collections.Counter(), collections.defaultdict(lambda: np.zeros(2))
    for s, n in threes.items():
        twos[s[1:]] += n
        after[s[:2]] += (n, 1)
    for s, n in twos.items():
        after[s[:1]] += (n, 1)
    step = lambda n, total, kinds, p: max(n - 0.75, 0) / total + min(1, 0.75 * kinds / total) * p if total else p
    probe = sorted({w for text, _ in rows for w in text.split()})[::7] + ["neverseen", "q"]
    for w, got in zip(probe, model.ratios(probe), strict=True):
        want = 0.0
        for g in grams_of(w):
            s, (a, b), c = g[-3:], grams.get(g, (0, 0)), sums[g[:-1]]
            p = step(threes[s], *after[s[:2]], step(twos[s[1:]], *after[s[1:2]], 1 / 256))
            p = step(a + b, c[4], c[5], p)
            want += np.log(step(b, c[1], c[3], p)) - np.log(step(a, c[0], c[2], p))
        assert abs(got - want) < 1e-3


def test_toxicity_learns_from_both_folds(spark):
    """An expression whose labelled documents are all in fold 2 is learned."""
    r = random.Random(23)
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    rows = []
    for i in range(900):
        bad = i % 4 == 0
        slur = ["grumpaw", "slorgak"][fold(i) == 2 or i % 8 == 0 and fold(i) == 1] if bad else letters(r, 7)
        rows.append((i, " ".join([*(letters(r, r.randint(2, 6)) for _ in range(30)), *[slur] * 3]), int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache(), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scorer = toxicity.Scorer(docs.drop("toxic"), labels)
    low, high = scorer.model.value.ratios([letters(r, 7), "slorgak"])
    assert high > low + 3
    rows = toxicity.labelled(docs.drop("toxic"), labels)
    n = {y: rows.filter((F.col("fold") == 2) & (F.col("toxic") == y)).count() for y in (0, 1)}
    aside = rows.filter(toxicity.set_aside(rows, n))
    assert aside.filter("fold <> 2").count() == 0 and {y: aside.filter(F.col("toxic") == y).count() for y in n} == {y: k // 2 for y, k in n.items()}


def test_line_dedup_finds_short_passages(spark):
    """Every passage of 50 to 60 words goes from all texts but the first, whatever its hashes; clauses with full-width marks too."""
    r = random.Random(24)
    clause = lambda: " ".join(letters(r, r.randint(2, 7)) for _ in range(7)) + r.choice([". ", ", ", "; "])
    wide = lambda: letters(r, 12, "的一是不了人我在有他这中大来上") + r.choice("。，；")
    texts, passages = [], []
    for k in range(80):
        make = wide if k % 4 == 0 else clause
        passage = "".join(make() for _ in range(8))
        passages.append(passage)
        texts += ["".join([*(make() for _ in range(5)), passage, *(make() for _ in range(5))]) for _ in range(3)]
    path = scratch_path(spark, "test")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(spark.read.parquet(path)).collect()}
    for k, passage in enumerate(passages):
        assert got[3 * k] == texts[3 * k]
        for i in (3 * k + 1, 3 * k + 2):
            assert got[i] == texts[i].replace(passage, "")


def test_secrets_learns_from_rare_findings(spark):
    """Twenty secrets in 40,000 documents are enough for a network."""
    key = F.when(F.col("id") % 2000 == 7, F.concat(F.lit("token="), F.md5(F.col("id").cast("string")))).otherwise(F.concat(F.lit("see release-notes-of-2024-"), F.col("id")))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), key.alias("text"))
    assert secrets.train(docs) is not None


def brute_dedup(rows):
    """Texts left by chunk removal, by its definition alone. rows: (doc_id, text), distinct."""
    hashed = lambda x, seed=42: xxhash.xxh64_intdigest(x, seed)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    chunks, lines, tids = {}, {}, {}
    for d, t in rows:
        if t is None:
            continue
        x = lines[d] = line_cuts(t)
        tids[d] = signed(hashed(t.encode()))
        h = [hashed(y.encode()) for y in x]
        r = [signed(hashed(b.to_bytes(8, "little"), a_)) for a_, b in zip([hashed(a.to_bytes(8, "little")) for a in h], h[1:], strict=False)]
        for i in range(len(r)):
            span = line_dedup.SPAN
            near = [r[j] if 0 <= j < len(r) else float("inf") for j in range(i - span + 1, i + span)]
            if any(r[i] <= min(near[j : j + span]) for j in range(span)):
                chunks.setdefault("".join(x[i : i + 2]), []).append((d, tids[d], i))
    gone = {d: set() for d in lines}
    for text, at in chunks.items():
        if len(at) < 2 or not text.strip():
            continue
        first = min(at)
        for d, t, i in at:
            if (d, t, i) != first:
                gone[d] |= {i, i + 1}
                if d != first[0]:
                    a, b = lines[d], lines[first[0]]
                    for step, own, its in ((-1, i, first[2]), (1, i + 1, first[2] + 1)):
                        for k in range(1, line_dedup.EDGE + 1):
                            p, q = own + step * k, its + step * k
                            if min(p, q) < 0 or p >= len(a) or q >= len(b) or a[p] != b[q]:
                                break
                            gone[d].add(p)
    return {d: "".join(x for i, x in enumerate(lines[d]) if i not in gone[d]) for d in lines}


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(25)
    clause = lambda: " ".join(letters(r, r.randint(1, 8)) for _ in range(r.randint(1, 25))) + r.choice([". ", ", ", "; ", "\n", " "])
    shared = ["".join(clause() for _ in range(r.randint(2, 9))) for _ in range(12)]
    texts = []
    for _ in range(90):
        parts = [clause() for _ in range(r.randint(0, 6))] + [r.choice(shared) for _ in range(r.randint(0, 3))] + [clause() for _ in range(r.randint(0, 4))]
        r.shuffle(parts)
        texts.append("".join(parts))
    texts += [None, "", "\n\n\n", "yes. yes. yes. yes. yes. yes. yes. yes. ", shared[0] * 3, "word " * 5000]
    rows = list(enumerate(texts))
    path = scratch_path(spark, "test")
    odd = {"__lines": F.lit(1), "a.b": F.lit(2), "__n_removed": F.lit(3), "__gone": F.lit("x"), "n_chars": F.length("text").cast("long"), "key": F.lit("k")}
    spark.createDataFrame(rows, "doc_id long, text string").withColumns(odd).write.parquet(path)
    docs = spark.read.parquet(path)
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs.select("doc_id", "text")).collect()}
    want = brute_dedup(rows)
    assert [i for i in want if got[i] != want[i]] == []
    assert sum(got[i] != texts[i] for i in want) > 20
    left = line_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    assert {x["doc_id"]: (x["text"], x["n_chars"]) for x in left.collect() if (x["text"] or "").strip()} == {i: (t, len(t)) for i, t in want.items() if t.strip()}
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0
