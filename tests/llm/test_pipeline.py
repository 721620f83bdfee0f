"""The pipeline end to end on the small tables, against a brute-force version of what each stage must do."""

import os
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from fernspan.llm import toxicity
from fernspan.llm.vocabulary import default_path, unusual, vocabulary
from fernspan.session import keep, table
from tests.llm.test_whole import brute_dedup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def grams(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        out = keep(stage(spark, docs, SF), f"test_{name}")
        seen.append((name, before, out))
        docs = out
    for name, before, out in seen[:-1]:
        assert out.columns == columns, name
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before)
        if name == "ngram_join":  # no two documents left link, by what they are or by what they were; one of each group stays
            whole = {r["doc_id"]: grams(r["text"]) for r in table(spark, SF, "documents").collect()}
            now = {i: grams(t) for i, t in before.items()}
            link = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y)
            either = lambda i, j: link(now[i], now[j]) or link(whole[i], whole[j]) or link(now[i], whole[j]) or link(whole[i], now[j])
            ids = sorted(after)
            assert not any(either(a, b) for n, a in enumerate(ids) for b in ids[:n])
            for i in set(before) - set(after):
                assert any(either(i, j) for j in before if j != i)
        if name == "toxicity":  # what the operator calls toxic goes, and nothing else
            called = {r["doc_id"] for r in toxicity.score_documents(table(spark, SF, "documents"), table(spark, SF, "labels")).filter("predicted = 1").collect()}
            assert set(before) - set(after) == called and all(after[i] == before[i] for i in after)
        if name == "line_dedup":
            left = brute_dedup(sorted((i, t) for i, t in before.items()))
            want = {i: t for i, t in before.items() if t is None} | {i: t for i, t in left.items() if t == before[i] or t.strip()}
            assert after == want
        if name == "decontamination":
            items = [re.findall(r"\w+", r["text"].lower()) for r in table(spark, SF, "benchmark").collect()]
            for t in after.values():
                w = " " + " ".join(re.findall(r"\w+", t.lower())) + " "
                assert not any(" " + " ".join(x) + " " in w for x in items)
    _, before, packed = seen[-1]
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, packed.collect()))
    tok = vocabulary(default_path(), unusual(default_path())).tokenizer
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == set(before)
    for r in rows[:50]:
        ids = [*tok.encode(before[r["doc_id"]] or "", add_special_tokens=False).ids, 2][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
