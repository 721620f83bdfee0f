"""Chains, hot buckets, repeated ids and cut documents in the n-gram join."""

import random

import pytest

from fernspan.llm import ngram_join
from tests.llm.test_llm import CLASH, brute_groups, corpus, documents, saved, words


def test_chain_of_revisions(spark):
    """200 revisions of a page, each near the one before, ids rising along the chain: one component."""
    r = random.Random(4)
    w, texts = words(r, 120), []
    for k in range(200):
        texts.append(" ".join(w))
        w[(7 * k) % 120] = f"rev{k}"
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join_ngrams(saved(documents(spark, texts), spark)).collect()}
    sizes, groups = brute_groups(texts)
    assert len(set(groups)) == 1
    assert [got[i] for i in range(200)] == groups


@pytest.mark.parametrize(("salt_rows", "slice_"), [(4, 512), (1 << 20, 3), (2, 2)])
def test_hot_buckets_in_parts(spark, monkeypatch, salt_rows, slice_):
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", salt_rows)
    monkeypatch.setattr(ngram_join, "SLICE", slice_)
    texts = corpus(9, 30)
    shared = "one passage of nine words that all begin with"
    texts += [shared + " " + " ".join(words(random.Random(100 + k), 6)) for k in range(20)]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join_ngrams(saved(documents(spark, texts), spark)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)[1]


def test_cells_summed_in_two_steps(spark):
    texts = corpus(11, 25)
    d = documents(spark, texts).repartition(80)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join_ngrams(d.persist()).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)[1]


def test_rows_that_share_an_id_keep_their_own_sets(spark):
    a = " ".join(words(random.Random(1), 60)).split()
    near = a[:-1] + ["changed"]
    other = " ".join(words(random.Random(2), 60))
    d = spark.createDataFrame([(1, " ".join(a)), (3, " ".join(near)), (3, other), (4, other + " more")], "doc_id long, text string")
    got = sorted((x["doc_id"], x["component_id"]) for x in ngram_join.join_ngrams(saved(d, spark)).collect())
    assert got == [(1, 1), (3, 1), (3, 3), (4, 3)]


def test_cut_copies_go_with_what_they_were(spark):
    """A near copy of which an earlier stage left a fragment goes; the fragment of a document of its own stays."""
    a, b = words(random.Random(5), 80), words(random.Random(6), 80)
    copy = a[:70] + ["x"] + a[71:]
    whole = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(copy)), (3, " ".join(b)), (9, " ".join(b))], "doc_id long, text string")
    docs = saved(documents(spark, ["", " ".join(a), " ".join(copy[66:]), " ".join(b[10:20]), None], CLASH + ", `a.b` long, `__copy` long"), spark)
    out = ngram_join.one_of_each(docs, saved(whole, spark))
    assert out.columns == docs.columns
    assert sorted(x["doc_id"] for x in out.collect()) == [0, 1, 3, 4]
    assert sorted(x["doc_id"] for x in ngram_join.one_of_each(docs).collect()) == [0, 1, 2, 3, 4]
