"""Benchmark passages without an item_id are looked for too."""

import random

from fernspan.llm import decontaminate
from tests.llm.test_llm import documents, saved, words


def test_passages_without_an_id(spark):
    r = random.Random(51)
    a, b, c = (" ".join(words(r, 20)) for _ in range(3))
    bench = spark.createDataFrame([(None, a), (None, b), (None, b), (4, c), (4, c)], "item_id long, text string")
    docs = saved(documents(spark, [f"before {a} after", f"{b} then {c}", f"{a} and {b}", "nothing of it"]), spark)
    got = {x["doc_id"]: (x["contaminated"], x["n_items"], x["item_ids"], x["max_similarity"]) for x in decontaminate.report(docs, bench).collect()}
    assert got == {0: (True, 1, [], 1.0), 1: (True, 2, [4], 1.0), 2: (True, 2, [], 1.0), 3: (False, 0, [], None)}
    assert [x["doc_id"] for x in decontaminate.clean(docs, bench).collect()] == [3]
