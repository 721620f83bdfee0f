"""Byte pairs, phrases and centroids against the library and brute force, with odd inputs."""

import collections
import math
import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernspan.llm import byte_pairs, centroids, phrases, warc
from fernspan.llm.vocabulary import default_path, overrides
from tests.llm.test_llm import CLASH, documents, saved

ALPHABET = ["'", "s", "t", "re", "ve", " ", "  ", "\n", "\t", "?", "!", "a", "b", "é", "à", " ", "　", "日", "本", "1", "2", "٣", "😀", "<|endoftext|>", "'ll", "x", "Z", "\x00", "\u0085", "ſ", "'S", "qzx", "�", "ⅷ", "²"]


def odd_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_encoding_equals_the_library(library):
    c = byte_pairs.codec(default_path(), overrides(default_path()))
    texts = odd_texts(8000) + ["a" * 70_000, " " * 5000 + "x", "ab" * 9999, "\n" * 3000, "word " * 20_000, "日本" * 9000, ""]
    texts += ["".join(map(chr, range(lo, lo + 64))) for lo in range(0, 0x3000, 64)]
    for text, ids, want in zip(texts, c.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text[:50]
        assert c.decode(ids.tolist()) == text
    assert (len(c.merge(b"ab" * 30)), c.merge(b"ab" * 30)) == (30, c._merge_long([c.single[x] for x in b"ab" * 30]))


def test_decoding_equals_the_library(library):
    c, r = byte_pairs.codec(default_path()), random.Random(5)
    for _ in range(2000):  # tokens in any order cut characters into pieces
        ids = [r.randrange(50257) for _ in range(r.randint(0, 8))]
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert c.decode([None, 10**6, 64]) == library.decode([64])


def test_forced_boundaries_hold():
    c = byte_pairs.codec(default_path())
    assert c.forced[ord("e"), ord(" ")] and not c.forced[ord(" "), ord("t")]
    assert all(b"%c%c" % (x, y) not in t for x, y in zip(*(a[:2000] for a in np.nonzero(c.forced)), strict=True) for t in [*c.bytes_of.values()][300:400])


def test_bpe_query_on_odd_tables(spark, library):
    texts = odd_texts(300, 8) + [None, "", "one " * 25_000, "x", "x"]
    d = saved(documents(spark, texts, CLASH).unionByName(documents(spark, ["again"], CLASH)), spark)
    got = collections.Counter(map(tuple, byte_pairs.digests(d).collect()))
    want = collections.Counter()
    for i, t in [*enumerate(texts), (0, "again")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    back = byte_pairs.decode(byte_pairs.encode(d))
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter([*((i, t or "") for i, t in enumerate(texts)), (0, "again")])
    assert byte_pairs.digests(d.limit(0)).count() == 0 and byte_pairs.digests(d.select("doc_id", "text").withColumn("doc_id", F.lit(None).cast("long"))).count() == len(texts) + 1


def brute_phrases(rows, least=10, top=2000, share=50):
    counts, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i : i + m])) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    out = collections.defaultdict(list)
    for (lang, p), a in counts.items():
        if a < least or len(p) < 2:
            continue
        longer = [f for (g, q), f in counts.items() if g == lang and len(q) > len(p) and f >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * f >= share * a for f in longer):
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


def mined(d, **how):
    return sorted(tuple(r) for r in phrases.collocations(d, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def prose(seed=2, n=150):
    r = random.Random(seed)
    common = ["New York", "of the", "a a a a", "in spite of", "é à", "nb sp", "Machine LEARNING model", "x"]
    rows = [(r.choice(["en", "fr", None, "und"]), "".join(r.choice([*common, "zq%d" % r.randrange(40)]) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(r.randint(0, 60)))) for _ in range(n)]
    return [*rows, ("en", None), ("en", ""), ("fr", " \n\t.;"), ("en", "deep down " * 3000), *[("en", "copied text of some words")] * 30]


@pytest.mark.parametrize("bits", [2, 16])
def test_phrases_equal_brute_force(spark, monkeypatch, bits):
    """With eight buckets everything collides, and small hand-overs split all counts."""
    if bits == 2:
        monkeypatch.setattr(phrases, "bits_for", lambda rows: 3)
        monkeypatch.setattr(phrases, "GROUP_BYTES", 200)
        monkeypatch.setattr(phrases, "HELD", 50)
    rows = prose()
    d = spark.createDataFrame([(i, t, g, 1, "c") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, phrase string")
    assert mined(saved(d.repartition(5), spark)) == brute_phrases(rows)
    assert mined(d, top=3) == brute_phrases(rows, top=3)
    assert phrases.collocations(d.limit(0)).count() == 0


def test_phrase_scores_are_exact(spark):
    """Counts whose product passes 64 bits."""
    (one, two, three), totals = [spark.createDataFrame([("en", p, f) for p, f in rows], "lang string, phrase string, f long") for rows in ([("a", 3_000_000_019), ("b", 2_999_999_929)], [("a b", 2_999_999_929)], [])], spark.createDataFrame([("en", 1 << 40)], "lang string, n long")

    class Table:
        def __init__(self, df):
            self.df = df

    before = phrases.frequent_phrases
    phrases.frequent_phrases = lambda docs, least: ([Table(one), Table(two), Table(three)], totals)
    try:
        (row,) = phrases.collocations(one).collect()
    finally:
        phrases.frequent_phrases = before
    assert row["score"] == 1_000_000 * 2_999_999_929**2 // (3_000_000_019 * 2_999_999_929)


def brute_clusters(rows, k=40, rounds=5):
    v = [(i, tuple(math.floor(256 * c) for c in x)) for i, x in rows if x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) for c in x)]
    first = sorted((sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in v if i is not None)[:k]
    cents = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in v:
            groups[nearest(x)[1]].append(x)
        cents = [tuple(sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)) if groups[n] else c for n, c in enumerate(cents)]
    own = [(i, *nearest(x)[::-1]) for i, x in v]
    sums = collections.Counter()
    for _, n, d in own:
        sums[n] += d
    return collections.Counter((i, n, d, sums[n], sum(sums.values()), sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, n, d in own)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("c"), "v": F.lit(1), "label": F.lit(2)})


def test_clusters_equal_brute_force(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(i % 5, 0.4) for _ in range(64)]) for i in range(250)] + [(900 + i, [0.25] * 64) for i in range(40)]
    rows += [(3, [0.5] * 64), (3, [-0.5] * 64), (1000, None), (1001, [1.0] * 63), (1002, [float("nan")] * 64), (1003, [None, *[1.0] * 63]), (1004, [float("inf")] * 64), (1005, []), (None, [1.0] * 64)]
    assert collections.Counter(map(tuple, centroids.cluster(saved(vectors(spark, rows), spark)).collect())) == brute_clusters(rows)
    few = rows[:7]
    assert collections.Counter(map(tuple, centroids.cluster(vectors(spark, few)).collect())) == brute_clusters(few)
    assert centroids.cluster(vectors(spark, rows).limit(0)).count() == 0


def test_clusters_of_large_components(spark):
    r = random.Random(7)
    rows = [(i, [r.choice([-1, 1]) * r.random() * (1e6 if i % 2 else 3e4) for _ in range(64)]) for i in range(60)]
    assert collections.Counter(map(tuple, centroids.cluster(vectors(spark, rows)).collect())) == brute_clusters(rows)
    far = centroids.cluster(vectors(spark, [*rows, (99, [1e300] * 64), (98, [1e15] * 64)]))
    assert far.count() == 61 and far.filter("vec_id = 99").count() == 0 and far.filter("distance < 0").count() == 0


def test_annuli_prune_and_keep_ties():
    """Centroids on shells: only those of the vector's own shell are compared; equal distances go to the smaller number."""
    shells = [[(n + 1) * 100 if j == 0 else 0 for j in range(64)] for n in range(30)]
    a = centroids.Annuli([*shells, shells[4]])
    v = np.array([[510.0] + [0] * 63, [450.0] + [0] * 63, [0.0] * 64])
    which, d, compared = a.nearest(v)
    assert which.tolist() == [4, 3, 0] and d.tolist() == [100, 2500, 10000] and max(compared) <= 4
    mirrored = centroids.Annuli([[0, 100] + [0] * 62, [100] + [0] * 63])
    assert mirrored.nearest(np.array([[50.0, 50.0] + [0] * 62]))[0].tolist() == [0]


def test_warc_many_archives(spark, monkeypatch):
    """More archives than a task takes, repeated rows, a very long page and clashing columns: every record comes back, decisions equal the rule."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4096)
    monkeypatch.setattr(warc, "ARCHIVES_A_TASK", 2)
    r = random.Random(31)
    shared = ["<p>" + "x" * n + "</p>" for n in (120, 400, 93, 92)]
    rows = [(i, f"http://h/{i}", r.choice([*shared, None, "", f"<i>{i}</i>" * 30])) for i in range(300)]
    rows += [(300, None, "long " * 300_000), (301, "u", "long " * 300_000), *rows[:40]]
    pages = spark.createDataFrame([(*x, 7, b"z") for x in rows], "page_id long, url string, html string, archive int, content binary").repartition(3)
    got = collections.Counter(tuple(x) for x in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    first = {}
    for i, _, html in rows:
        if len(html or "") >= warc.REVISIT_BYTES:
            first[html] = min(i, first.get(html, i))
    seen, want = set(), collections.Counter()
    for i, _, html in sorted(rows, key=lambda x: x[0]):
        payload, again = (html or "").encode(), html in first and (first[html] < i or i in seen)
        seen.add(i)
        want[i, len(payload), sha256(payload).hexdigest(), "revisit" if again else "response", first[html] if again else None] += 1
    assert got == want
