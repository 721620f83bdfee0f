"""Decontamination against a brute force over every window of every document."""

import math
import random
import re

from pyspark.sql import functions as F

from fernspan.llm import decontaminate
from tests.llm.test_llm import documents, saved, words


def split(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def shingles(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute(texts, items):
    """(document, item): similarity of the best item-sized window, where it reaches the threshold."""
    known = {i: split(t) for i, t in items if t and split(t)}
    sets = {i: set(shingles(w, min(5, len(w)))) for i, w in known.items()}
    df = {}
    for s in sets.values():
        for x in s:
            df[x] = df.get(x, 0) + 1
    weight = {x: math.log(1 + len(known) / n) for x, n in df.items()}
    out = {}
    for d, t in enumerate(texts):
        w = split(t)
        for i, item in known.items():
            k, wide = min(5, len(item)), len(item) + 2 * (len(item) // 5 + 1)
            have = shingles(w, k)
            best = 0.0
            for at in range(len(have)):
                inside = sets[i] & set(have[at : at + wide - k + 1])
                best = max(best, sum(weight[x] for x in inside) / sum(weight[x] for x in sets[i]))
            if best >= 0.8 - 1e-9:
                out[d, i] = round(best, 6)
    return out


def test_equals_brute_force(spark):
    r = random.Random(31)
    sizes = [1, 2, 3, 4, 5, 6, 7, 9, 11, 11, 12, 15, 17, 20, 24, 30, 33, 41, 48, 60]
    items = [words(r, n) for n in sizes]
    for i in (12, 14, 16, 18):  # a phrase that several items share, so that weights are uneven
        items[i][2:10] = items[10][2:10]
    texts = []
    for i, item in enumerate(items):
        for start in range(16 if i in (8, 13) else 3):
            w = item[:]
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                at = r.randrange(len(w))
                edit = r.choice(["change", "insert", "delete", "last", "first"])
                if edit == "change":
                    w[at] = "changed"
                elif edit == "insert":
                    w.insert(at, "extra")
                elif edit == "delete" and len(w) > 1:
                    del w[at]
                else:
                    w[-1 if edit == "last" else 0] = "edge"
            texts.append(" ".join(words(r, 30 + start) + w + words(r, 20)))
    w = items[8][:]  # the last word of eleven changed, at every place
    for start in range(16):
        texts.append(" ".join(words(r, 40 + start) + w[:-1] + ["other"] + words(r, 20)))
    half = items[17]  # in two halves, near each other and far apart
    texts += [" ".join(half[:20] + words(r, n) + half[20:]) for n in (1, 5, 15, 60)]
    texts += [" ".join(half[20:] + half[:20]), " ".join(items[19] * 3), " ".join(["the"] * 400), None, "", "?!"]
    items.append(["the"] * 8)
    rows = [(i, ", ".join(x)) for i, x in enumerate(items)] + [(98, None), (99, " ")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.contaminated(saved(documents(spark, texts), spark), bench).collect()}
    want = brute(texts, rows)
    assert set(got) == set(want) and len(want) > 60
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_odd_rows(spark):
    r = random.Random(32)
    a, b = words(r, 20), words(r, 20)
    bench = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (None, "x y z"), (3, None)], "item_id long, text string")
    rows = [(7, " ".join(a)), (7, "nothing here"), (None, " ".join(a)), (8, None), (9, " ".join(words(r, 30_000) + b + words(r, 30_000)))]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a.b": F.lit(1), "found_id": F.lit(2), "key": F.lit("k")}), spark)
    got = sorted((x["doc_id"] or 0, x["contaminated"], x["item_ids"]) for x in decontaminate.report(docs, bench).collect())
    assert got == [(0, False, []), (7, True, [1]), (7, True, [1]), (8, False, []), (9, True, [1])]
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(x["doc_id"]) for x in left.collect()) == ["8", "None"]
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_window_fingerprints(spark):
    r = random.Random(33)
    h = [[r.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (3, 5, 9, 40)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(h)], "i long, H array<long>")
    got = decontaminate.windows(d, ["i"], 5).collect()
    assert len(got) == decontaminate.BLOCKS * (1 + 5 + 36)
    for x in got:
        five = h[x["i"]][x["pos"] : x["pos"] + 5]
        assert x["fp"] == sum(1 << b for b in range(60) if sum((v >> b) & 1 for v in five) > 2)


def test_fingerprints_decide(spark):
    """Windows near an item's by fingerprint count: its words in another order, or all but one that moves no bit; others with a word changed don't."""
    items = ["one two three four five", "na na na bat man", "red green blue"]
    texts = ["see two one three four five there", "see na na na bat girl there", "see one two three four six there", "blue red green", "red green black", "na na na cat girl"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(documents(spark, texts), bench).collect()}
    assert got == {(0, 0), (1, 1), (3, 2)}
