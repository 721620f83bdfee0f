"""The network is fitted on every distinct window, in parts, and its threshold is told by every held-out one."""

import random

import numpy as np

from fernspan.llm import secrets
from fernspan.session import keep


def test_every_window_is_fitted_on(spark, monkeypatch):
    r = random.Random(12)
    pick = lambda cs, n: "".join(r.choice(cs) for _ in range(n))
    texts = []
    for i in range(900):
        t = f"see {pick('aeioulmnr', 9)}-{pick('aeioulmnr', 9)} and {pick('xyzuvw', 14)} in {i}"
        texts.append(t + (f" password = {pick('ABCDEFabcdef0123456789', 24)} end" if i % 10 == 0 else ""))
    docs = keep(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "t_docs")
    monkeypatch.setattr(secrets, "PART_ROWS", 150)
    monkeypatch.setattr(secrets, "PART_RARE", 40)
    seen = []
    fit_parts = secrets._fit_parts

    def counted(rows, sizes):
        seen.append((rows.count(), dict(sizes)))
        return fit_parts(rows, sizes)

    monkeypatch.setattr(secrets, "_fit_parts", counted)
    net = secrets.train(docs)
    [(n, sizes)] = seen
    windows = {1: set(), 0: set()}
    for t in texts:
        base = secrets.base_spans(t)
        for label, spans in ((1, [(m.start(), m.end()) for s, _, e in base for m in secrets.CANDIDATE.finditer(t, s, e)]), (0, secrets.candidates(t, base))):
            windows[label] |= {secrets.window(t, u, v).tobytes() for a, z in spans for u, v in secrets.pieces(a, z)}
    assert n == sum(sizes.values()) and 0.5 < n / sum(map(len, windows.values())) < 0.8  # the rest is held out
    x = np.stack([np.frombuffer(w, np.uint8) for k in (0, 1) for w in sorted(windows[k])])
    y = np.repeat([0, 1], [len(windows[k]) for k in (0, 1)])
    called = net.probability(x) >= net.threshold
    assert called[y == 1].mean() > 0.9 and called[y == 0].mean() < 0.1
    again = secrets.train(docs.repartition(7, "text"))
    assert np.abs(again.flat() - net.flat()).max() < 1e-9


def test_batches_hold_every_window():
    y = np.array([0] * 1000 + [1] * 7)
    got = list(secrets._batches(y, np.random.default_rng(3)))
    assert set(np.concatenate(got).tolist()) == set(range(len(y)))
    assert all((y[b] == 1).sum() == secrets.RARE for b in got)
