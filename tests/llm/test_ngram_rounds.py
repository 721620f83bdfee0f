"""In large clusters few pairs have their sets compared."""

import random

from fernspan.llm import ngram_join
from fernspan.session import keep


def test_ngram_pairs_in_rounds(spark, monkeypatch):
    """In a large cluster few pairs have their sets compared, and components are those of all links."""
    r = random.Random(6)
    words = lambda n: [f"v{r.randrange(5000)}" for _ in range(n)]
    texts = [words(200) for _ in range(30)]
    seeds = [words(300), words(300)]
    for k in range(120):
        t = list(seeds[k % 2])
        t[r.randrange(300)] = f"new{k}"
        if k % 5 == 0:  # far enough from some copies, near to others
            t = t[: 280 - k // 5]
        texts.append(t)
    docs = keep(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), "t_docs")
    sets = [set(ngram_join.shingle_set(" ".join(t)).tolist()) for t in texts]
    own = list(range(len(texts)))
    for i in own:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((own[i], own[j]))
                own = [a if x == b else x for x in own]
    compared = []
    linked = ngram_join._linked

    def counted(pairs, sets):
        compared.append(pairs.count())
        return linked(pairs, sets)

    monkeypatch.setattr(ngram_join, "_linked", counted)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.join_ngrams(docs).collect()}
    assert [got[i] for i in range(len(texts))] == own
    assert compared[0] < 120 and sum(compared) < 300
