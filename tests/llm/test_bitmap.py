"""Steps whose tables must stay small: chunks are told by a bitmap."""

import random

from fernspan.llm import line_dedup
from fernspan.session import keep


def test_line_dedup_with_a_full_bitmap(spark, monkeypatch):
    """Keys that share their bits with repeated ones are found to be alone: the same rows whatever the bitmap's size."""
    r = random.Random(5)
    line = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(6)) + ". "
    shared = ["".join(line() for _ in range(9)) for _ in range(4)]
    texts = ["".join([line() for _ in range(12)] + r.sample(shared, i % 3) + [line()]) for i in range(60)]
    docs = keep(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "t_docs")
    rows = lambda: sorted(map(tuple, line_dedup.report(docs).collect()))
    want = rows()
    assert sum(x[1] for x in want) > 100
    monkeypatch.setattr(line_dedup, "BITS", 128)
    assert rows() == want
