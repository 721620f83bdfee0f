"""Rows that repeat an id, very long texts and empty tables, one operator after the other."""

import collections
import hashlib
import random
import zlib

import pytest

from fernspan.llm import ngram_join, packing, quality, secrets, token_count, topk, toxicity
from fernspan.llm.vocabulary import default_path
from tests.llm.test_llm import CLASH, DOC, brute_base, documents, saved, words

LONG_WORDS = 25_000


def rows(seed):
    """(doc_id, text): ids that repeat with other texts, with the same text, none at all, and one very long text."""
    r = random.Random(seed)
    some = [(k % 20, " ".join(words(r, r.randint(1, 60))) + f' token="{r.getrandbits(64):016x}" end') for k in range(30)]
    long = " ".join(words(r, LONG_WORDS)) + " password=abcdef99"
    return [*some, *some[:5], (None, some[0][1]), (None, None), (7, None), (7, ""), (50, long), (51, long)]


def frame(spark, data):
    extra = CLASH.count(",") - DOC.count(",")
    return saved(spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, *[None] * extra) for i, t in data], CLASH), spark)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_token_counts_row_by_row(spark, library):
    data = rows(41)
    got = collections.Counter((x["doc_id"], x["n_bytes"], x["n_tokens"]) for x in token_count.count_tokens(frame(spark, data)).collect())
    assert got == collections.Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in data)
    assert token_count.count_tokens(documents(spark, []).limit(0)).count() == 0


def test_secrets_row_by_row(spark):
    data = rows(42)
    got = collections.Counter((x["doc_id"], x["base_sha256"]) for x in secrets.scan(frame(spark, data)).collect())
    assert got == collections.Counter((i, hashlib.sha256(brute_base(t or "").encode()).hexdigest()) for i, t in data)
    assert secrets.scan(documents(spark, []).limit(0)).count() == 0


def test_toxicity_row_by_row(spark):
    r = random.Random(43)
    learned = [(1000 + k, " ".join(words(r, 30) + ["slorgak"] * (2 * (k % 4 == 0)))) for k in range(600)]
    data = [*learned, *rows(43), (1, "slorgak " * 6 + "you slorgak"), (1, " ".join(words(r, 20)))]
    labels = spark.createDataFrame([(i, int("slorgak" in t)) for i, t in learned] + [(1000, 0), (1000, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(frame(spark, data), labels)
    at = got.collect()
    assert collections.Counter(x["doc_id"] for x in at) == collections.Counter(i for i, _ in data)
    assert sum(x["predicted"] for x in at if x["doc_id"] == 1) == 1  # of the rows with this id the toxic one alone
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in at)
    (a,), (b,) = ({x["score"] for x in at if x["doc_id"] == i} for i in (50, 51))
    assert a == b and 0 <= a <= 1
    assert toxicity.score_documents(documents(spark, []).limit(0), labels).count() == 0


def test_packing_row_by_row(spark, library):
    data = rows(44)
    got = packing.pack(frame(spark, data)).collect()
    held = collections.Counter()
    for i, t in data:
        held[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    have, sequences = collections.Counter(), collections.defaultdict(list)
    for x in got:
        have[x["doc_id"]] += x["length"]
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    assert have == held
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_quality_row_by_row(spark):
    data = rows(45)
    got = quality.rate_documents(frame(spark, data)).collect()
    assert collections.Counter(x["doc_id"] for x in got) == collections.Counter(i for i, _ in data)
    (a,), (b,) = ({tuple(v for k, v in x.asDict().items() if k != "doc_id") for x in got if x["doc_id"] == i} for i in (50, 51))
    assert a == b


def test_ngram_join_of_very_long_texts(spark):
    r = random.Random(46)
    w = words(r, LONG_WORDS)
    near = w[:]
    for k in range(0, LONG_WORDS, 100):  # five shingles of a hundred each: about 0.9 alike
        near[k] = "changed"
    far = w[: LONG_WORDS // 2] + words(r, LONG_WORDS // 2)
    got = {x["doc_id"]: x for x in ngram_join.join_ngrams(saved(documents(spark, [" ".join(x) for x in (w, near, far)]), spark)).collect()}
    assert [got[i]["component_id"] for i in range(3)] == [0, 0, 2]
    assert got[0]["n_shingles"] == len({tuple(w[i : i + 5]) for i in range(LONG_WORDS - 4)})


def test_topk_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, score long")
    assert topk.search(empty).count() == 0
